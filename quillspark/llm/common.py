"""Helpers shared by the operators: stored intermediate tables and collision-free column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a session on one machine makes a folder of its own once; a cluster has no
    folder that we could choose for it, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("quillspark.own.checkpoint.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.own.checkpoint.dir", own)
    return own


#: Paths staged inside each open ``passing_tables`` block, innermost last.
_open: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    This cuts the lineage, survives lost executors and freezes values that depend on task layout.
    The folder is removed at the end of the ``passing_tables`` block it is made in, else when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, store = _folder(spark, path)
    store.deleteOnExit(where)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside the block go at its end; what the yielded function stages outlives it."""
    mine: list[str] = []
    outer = _open[-1] if _open else None

    def lasting(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        path = mine.pop()
        if outer is not None:
            outer.append(path)
        return out

    _open.append(mine)
    try:
        yield lasting
    finally:
        _open.remove(mine)
        for path in mine:
            where, store = _folder(spark, path)
            store.delete(where, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def thinned(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """About ``size`` rows of ``df``, those whose key hashes lowest; all of them if there are fewer.

    The share follows from the count, so no task orders or gathers more than the sample.
    """
    n = df.count()
    if n <= size:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys, F.lit(13)), F.lit(1 << 31)) < int((1 << 31) * size / n))


#: Keys of at most so many rows (half a megabyte) are broadcast.
BROADCAST_KEYS = 50_000


def keyed(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``df`` with a long column that tells its rows apart, and the name of that column.

    The id serves where it is never null and never repeats; else the rows are numbered and stored, so that
    the numbers hold whatever is computed from them later.
    """
    name, ident = fresh(df, "__row"), F.col(f"`{id_col}`").cast("long")
    if df.groupBy(ident.alias("id")).count().filter("count > 1 or id is null").isEmpty():
        return df.withColumn(name, ident), name
    return staged(df.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def without_keys(table: DataFrame, key: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose key is not in ``gone`` (one long column): broadcast if few, else a shuffle join."""
    name = fresh(table, "__gone")
    gone = gone.toDF(name).distinct()
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return table.join(gone, F.col(key) == F.col(name), "left_anti").select(*(F.col(f"`{c}`") for c in columns))


#: Copies of the smaller table in a salted join.
SALTS = 32


def spread_join(rows: DataFrame, table: DataFrame, on: str | list[str], salt_by: str, how: str = "inner", most: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` joined with the one row that ``table`` has for their key, which very many rows may share.

    A table of at most ``most`` rows is broadcast; a larger one meets the rows by key and a salt drawn from ``salt_by``.
    """
    keys = [on] if isinstance(on, str) else on
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    salt = fresh(rows, "__salt")
    salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(salted, [*keys, salt], how).drop(salt)


#: Rows of one key that may meet in one task.
ALIKE = 10_000


def counted_join(rows: DataFrame, table: DataFrame, on: list[str], salt_by: str, count: str, how: str = "inner", most: int = ALIKE) -> DataFrame:
    """``rows`` joined (inner or left) with the one row that ``table`` has for their key, where ``count`` tells about how many rows have it.

    Keys of more than ``most`` rows are few beside the rows and meet them by ``spread_join``; all others meet by
    key. Rows with a null in their key match nothing and are not shuffled. Both are read more than once: store them before.
    """
    flag, whole = fresh(rows, "__many"), F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    met = spread_join(rows.filter(whole), table.filter(F.col(count) > most).withColumn(flag, F.lit(True)), on, salt_by, "left")
    few = met.filter(F.col(flag).isNull()).select(*rows.columns).join(table.filter(F.col(count) <= most), on, how)
    out = met.filter(flag).drop(flag).unionByName(few)
    return out.unionByName(rows.filter(~whole), allowMissingColumns=True) if how == "left" else out


def trimmed(run):
    """An Arrow function that hands freed memory back to the system when its task ends.

    Python workers live on between tasks; without this each keeps the most that any task has needed.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped
