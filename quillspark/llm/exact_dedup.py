"""Exact deduplication by a tree-merge of sorted digest runs.

Every task turns its rows into a run sorted by digest, with one entry for each digest. Runs then meet in
rounds of a binomial exchange (``FAN_IN`` = 4 joins two binary rounds into one): in round r a slot sends
each entry to the slot whose r-th digit is the r-th digit of the entry's digest slice, and the receiver
merges the sorted runs and keeps one entry for each digest. After the last round slot s owns slice s. A
digest that a third of all rows share costs at most one entry a run at each level, so no task sees the
group whole. Entries carry the SHA-256 of the normalised text, and equality is decided on all 256 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import counted_join, keyed, partitions, staged, trimmed, without_keys

FAN_IN = 4
#: Characters that do not count when texts are compared.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
DIGEST = ("d0", "d1", "d2", "d3")
KEYED = "doc_id long, uid long, n_chars long, d0 long, d1 long, d2 long, d3 long"
ENTRY = "slot int, d0 long, d1 long, d2 long, d3 long, n_chars long, doc_id long, uid long, n long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests by row; rows that bring no key are numbered."""
    uid = TaskContext.get().partitionId() << 36
    for b in batches:
        sums = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, BLANKS)).digest() for t in b.column(1)]
        d = np.frombuffer(b"".join(sums), dtype=">i8").reshape(-1, 4).astype("<i8")
        own = b.column(3) if b.num_columns > 3 else pa.array(np.arange(uid, uid + len(sums)))
        cols = [b.column(0), own, b.column(2), *(pa.array(d[:, i].copy()) for i in range(4))]
        uid += len(sums)
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "uid", "n_chars", *DIGEST])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest and rank: keep the first of each digest, add up the counts.

    The last digest of a batch is held back, as the next batch may go on with it.
    """
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_arrays(b.columns, names=b.schema.names)  # all nullable, whatever the plan says
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for c in DIGEST:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(t.column("n").to_numpy(), first)
        t = t.take(pa.array(first)).set_column(t.schema.get_field_index("n"), "n", pa.array(total))
        held = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _sorted(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions(*DIGEST, F.desc("n_chars"), F.asc_nulls_last("doc_id"), "uid")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (and row_key with ``key_col``).

    Texts are equal when they are identical without the characters of ``BLANKS``. Of equal texts the row
    with the most code points stays, then the smallest id, then (for repeated rows) any one row. A null
    text counts as empty, so all empty texts form one group; a null id ranks last; an empty table gives an
    empty result; other columns are ignored, whatever their names. ``key_col`` names a long column that
    tells rows apart.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.length(text).cast("long").alias("n_chars"), *([F.col(key_col).alias("uid")] if key_col else []))
    hashed = staged(rows.mapInArrow(trimmed(_digests), KEYED), "digests")
    slots, rounds = FAN_IN, 1
    while slots < partitions(df.sparkSession):
        slots, rounds = slots * FAN_IN, rounds + 1
    entries = hashed.select(F.pmod(F.spark_partition_id(), F.lit(slots)).cast("int").alias("slot"), *DIGEST, "n_chars", "doc_id", "uid", F.lit(1).cast("long").alias("n"))
    entries = _sorted(entries).mapInArrow(trimmed(_merge), ENTRY)
    share = F.expr(f"cast(pmod(d0, {slots}) as int)")
    for r in range(rounds):
        unit = FAN_IN**r
        digit = lambda c: F.floor(c / unit).cast("int") % FAN_IN  # noqa: B023, E731
        met = entries.withColumn("slot", (F.col("slot") + (digit(share) - digit(F.col("slot"))) * unit).cast("int"))
        entries = _sorted(met.repartitionById(slots, F.col("slot"))).mapInArrow(trimmed(_merge), ENTRY)
    kept = staged(entries.filter("n > 1").select(*DIGEST, F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size")), "kept")
    joined = counted_join(hashed, kept, list(DIGEST), "uid", "group_size", "left")
    alone = F.col("keep_uid").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in DIGEST))).alias("text_sha256"),
        *([F.col("uid").alias("row_key")] if key_col else []),
    )


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all their columns, whatever the names.

    Rows are told apart by a key of their own, so repeated or null ids lose nothing but copies: rows of one id
    and different texts stay, rows that repeat both leave one. All null and blank texts are one group. An
    empty table gives an empty result.
    """
    table, key = keyed(df, id_col)
    found = staged(exact_dedup(table, id_col, text_col, key), "copies")
    return without_keys(table, key, found.filter("not kept").select("row_key"), df.columns)
