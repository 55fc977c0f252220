"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The mean number of copies of each document of a source is target weight x total volume / volume of the
source. A hash of seed and id, read as a uniform number, is put through the inverse of that Poisson
distribution; the document is exploded by its count and every copy goes to a place drawn by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, partitions, staged

SEED = "mix-1"
#: Target weight of a source: volume to this power (1 keeps the sources' shares, 0 makes them equal).
EXPONENT = 0.7
#: Rates of at most so many sources are broadcast; with more, the rates are joined by salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 64
#: The largest rate whose terms are added from 0 copies on; above it exp(-rate) may vanish, and the sum starts below all doubles' reach.
LARGEST_RATE = 400.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts, the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k at which the Poisson distribution function of ``rate`` reaches u.

    Terms are added up to rate + 12 standard deviations + 20, beyond which no double u lies. They start at 0, for large
    rates at 12 standard deviations + 20 below the rate, where the first term follows from Stirling's series.
    """
    reach = 12 * F.sqrt(rate) + 20
    first = F.when(rate > LARGEST_RATE, F.floor(rate - reach)).otherwise(0).cast("int")
    # log(first! e^first / first^first), and first log(first / rate) - first + rate without cancellation
    stirling = 0.5 * F.log(2 * F.pi() * first) + 1 / (12 * first) - 1 / (360 * F.pow(first, F.lit(3)))
    e = (first - rate) / rate
    apart = rate * ((1 + e) * F.log1p(e) - e)
    term = F.when(rate > LARGEST_RATE, F.exp(-apart - stirling)).otherwise(F.exp(-rate))
    start = F.struct(term.alias("term"), term.alias("cdf"), first.alias("k"))
    steps = F.sequence(first + 1, (rate + reach).cast("int"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * rate / i
        return F.when(acc["cdf"] >= u, acc).otherwise(F.struct(term.alias("term"), (acc["cdf"] + term).alias("cdf"), i.alias("k")))

    return F.aggregate(steps, start, add, lambda acc: acc["k"])


def rates(df: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, exponent: float) -> DataFrame:
    """source, rate. Volumes are code points; a source without volume has rate 1."""
    volume = F.sum(F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).cast("double")
    by = df.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).agg(volume.alias("volume"))
    if weights is None:
        aim = F.pow(F.col("volume"), F.lit(exponent))
    else:
        aim = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("source")), F.lit(0.0))
    by = by.withColumn("aim", F.when(F.col("volume") > 0, aim).otherwise(0.0))
    total = by.agg(F.sum("volume").alias("all_volume"), F.sum("aim").alias("all_aim")).withColumn("one", F.lit(1))
    rate = F.col("aim") / F.col("all_aim") * F.col("all_volume") / F.col("volume")
    return by.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("source", F.when(F.col("volume") > 0, rate).otherwise(1.0).alias("rate"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    exponent: float = EXPONENT,
    seed: str = SEED,
    with_position: bool = False,
) -> DataFrame:
    """Each row of ``df`` as often as the draw says, in a global random order.

    ``weights`` gives target weights by source (sources without one go); else they follow ``exponent``.
    ``with_position`` adds copy (from 0), n_copies, rate and order_key, by which partitions are sorted. A null source
    is the source "", a null text has no volume, a null id draws as "". Repeated rows draw alike. An empty
    table gives an empty result. All columns are kept; names of ours give way to clashing ones.
    """
    spark = df.sparkSession
    names = {k: fresh(df, k) for k in ("copy", "n_copies", "rate", "order_key", "__source", "__salt")}
    table = staged(rates(df, source_col, text_col, weights, exponent), "rates")
    table = table.select(F.col("source").alias(names["__source"]), F.col("rate").alias(names["rate"]))
    key = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = df.withColumn(names["__source"], key)
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), names["__source"])
    else:
        rows = rows.withColumn(names["__salt"], F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
        salted = table.withColumn(names["__salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(salted, [names["__source"], names["__salt"]]).drop(names["__salt"])
    rate = F.col(names["rate"])
    drawn = poisson_inverse(uniform(F.lit(seed), F.lit("n"), ident), rate)
    rows = rows.withColumn(names["n_copies"], drawn.cast("int")).filter(F.col(names["n_copies"]) > 0)
    rows = rows.withColumn(names["copy"], F.explode(F.sequence(F.lit(0), F.col(names["n_copies"]) - 1)))
    rows = rows.withColumn(names["order_key"], F.md5(F.concat_ws(":", F.lit(seed), F.lit("at"), ident, F.col(names["copy"]).cast("string"))))
    rows = rows.repartition(partitions(spark), F.col(names["order_key"])).sortWithinPartitions(names["order_key"])
    added = ["copy", "n_copies", "rate", "order_key"] if with_position else []
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), *(names[c] for c in added))
