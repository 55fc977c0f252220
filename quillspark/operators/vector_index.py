"""A stored flat index: vectors in blocks of near ones, with norms and the bounds of each block beside them; searches stay exact.

Vectors go to the nearest of a bounded sample of pivots, and those of a pivot to blocks of a bounded size. A block's centre and radius bound the distance
that any of its vectors can have from a question. A search first visits, for each question, the blocks of the least bounds until they hold k vectors;
the worst of those k distances is a threshold, and then only blocks whose bound reaches it are visited. What a search does not visit is not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.vectors import LEAST_NORM, norm
from quillspark.operators import retrieval
from quillspark.sources.sinks import index_metric
from quillspark.sources.store import stored

#: Pivots at most (a documented sample; every vector is stored), vectors of a block on average at most.
MOST_PIVOTS, BLOCK_ROWS = 1024, 4096
#: Pairs of question and block that are broadcast; beyond that every block is scanned.
MOST_VISITS = 2_000_000
#: What rounding may take from a bound, so that no block is left out by it.
SLACK = 1e-9


@dataclass
class VectorIndex:
    metric: str  # ip, cosine or l2
    rows: DataFrame  # block, chunk_pos, embedding, norm
    blocks: DataFrame  # block, n, centre, radius


def _nearest(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        for b in batches:
            if not b.num_rows:
                continue
            v = retrieval._matrix(b.column(1))
            far = (pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far.argmin(axis=1), pa.int32())], names=["chunk_pos", "embedding", "norm", "cell"])

    return run


def build(chunks: DataFrame, path: str, metric: str = "cosine", pivots: int = MOST_PIVOTS) -> VectorIndex:
    """Store ``chunks`` (chunk_pos, embedding) below ``path`` for a metric named as indexes are: cosine, or l2.

    ``cosine`` stores vectors at length 1 and searches by inner product of these, ``l2`` as they are. Rows without a
    position or a vector are left out.
    """
    serves, spark = index_metric(metric), chunks.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = chunks.select(F.col("chunk_pos").cast("long").alias("chunk_pos"), v.alias("embedding")).filter("chunk_pos is not null and embedding is not null")
    rows = rows.withColumn("norm", norm(F.col("embedding")))
    if serves == "ip":
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x / F.greatest(F.col("norm"), F.lit(LEAST_NORM))))
    n = rows.count()
    pivots = max(1, min(pivots, MOST_PIVOTS, int(n**0.5)))
    share = F.pmod(F.xxhash64("chunk_pos"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, 2 * pivots / max(1, n)))
    sample = rows.filter(share).select("embedding").limit(4 * pivots).toArrow()
    centres = retrieval._matrix(sample.column(0).combine_chunks())[:pivots] if sample.num_rows else np.zeros((1, 1))
    placed = rows.select("chunk_pos", "embedding", "norm").mapInArrow(_nearest(spark.sparkContext.broadcast(centres)), "chunk_pos long, embedding array<double>, norm double, cell int")
    placed = stored(placed, "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    split = placed.join(F.broadcast(sizes), "cell")  # one row a pivot
    block = F.col("cell").cast("long") * (1 << 20) + F.pmod(F.xxhash64("chunk_pos", F.lit(1)), F.col("parts"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = split.select(block.alias("block"), "chunk_pos", "embedding", "norm").repartition(parts, "block").sortWithinPartitions("block", "chunk_pos")
    laid.write.mode("overwrite").parquet(f"{path}/rows")
    at = spark.read.parquet(f"{path}/rows")
    sums = at.select("block", F.posexplode("embedding").alias("i", "x")).groupBy("block", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    centre = sums.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n")).select("block", "n", F.transform("c", lambda s: s["x"]).alias("centre"))
    away = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    bounds = at.join(centre, "block").groupBy("block").agg(F.max(away).alias("radius"), F.first("n").alias("n"), F.first("centre").alias("centre"))
    bounds.withColumn("metric", F.lit(metric)).write.mode("overwrite").parquet(f"{path}/blocks")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    blocks = spark.read.parquet(f"{path}/blocks")
    first = blocks.select("metric").first()
    return VectorIndex(first["metric"] if first else "cosine", spark.read.parquet(f"{path}/rows"), blocks.drop("metric"))


def _bounds(held, metric: str):
    """query_id, block, n and the least distance that the block can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                c, radius = retrieval._matrix(part.column(2)), part.column(3).to_numpy()
                if metric == "l2":
                    far = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * q @ c.T, 0.0))
                    least = np.maximum(far - radius[None, :] - SLACK * (1 + far), 0.0) ** 2
                else:  # all have length 1
                    least = 1 - q @ c.T - radius[None, :] - SLACK
                k = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.tile(part.column(0).to_numpy(), len(ids))), pa.array(np.tile(part.column(1).to_numpy(), len(ids))), pa.array(least.ravel())], names=["query_id", "block", "n", "least"])

    return run


def _visit(held, metric: str, k: int, decimals: int):
    """The k best of each visited block for the questions that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, of = held.value
        for b in batches:
            block = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (own := of.get(int(block[start]))) is not None:
                    chunks = retrieval._Chunks(metric, b.column(1)[start:stop].to_numpy(), retrieval._rows(b.column(2)[start:stop]))
                    yield from retrieval._best(metric, k, decimals, ids[own], q[own], chunks)

    return run


def search(index: VectorIndex, queries: DataFrame, k: int = 50, decimals: int = 9) -> tuple[DataFrame, dict[str, int]]:
    """query_id, chunk_pos, score, retrieval_rank as ``retrieval.top_k`` gives them for the index's metric, and what was visited.

    Scores are those of the metric: 1 - cosine, or the squared distance. Questions (``retrieval.QUERY_BLOCK`` at most, more are an error) without an
    id or a vector are left out. The counts name all pairs of question and block, and those that were visited.
    """
    spark = queries.sparkSession
    t = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("query_id is not null and embedding is not null").limit(retrieval.QUERY_BLOCK + 1).toArrow()
    if t.num_rows > retrieval.QUERY_BLOCK:
        raise ValueError(f"more than {retrieval.QUERY_BLOCK} questions: search by parts, or scan with top_k")
    ids = t.column(0).to_numpy()
    q = retrieval._matrix(t.column(1).combine_chunks()) if len(ids) else np.zeros((0, 0))
    if index.metric == "cosine" and len(ids):
        q = q / np.maximum(np.sqrt((q * q).sum(axis=1)), LEAST_NORM)[:, None]
    held = spark.sparkContext.broadcast((ids, q))
    bounds = stored(index.blocks.select("block", "n", "centre", "radius").mapInArrow(_bounds(held, index.metric), "query_id long, block long, n long, least double"), "bounds") if len(ids) else None
    schema = "query_id long, chunk_pos long, score double"
    if bounds is None or bounds.isEmpty():
        return spark.createDataFrame([], f"{schema}, retrieval_rank int"), {"pairs": 0, "visited": 0}

    def visited(pairs: DataFrame) -> tuple[DataFrame, int, bool]:
        """What the pairs find, their number, and whether all blocks were scanned in their place."""
        some = pairs.limit(MOST_VISITS + 1).toArrow()
        whole = some.num_rows > MOST_VISITS
        if whole:  # too many to hand out: every question meets every block
            every = np.arange(len(ids))
            blocks = {b: every for b in index.blocks.select("block").toArrow().column(0).to_pylist()}
        else:
            place = {x: i for i, x in enumerate(ids.tolist())}
            who, where = np.array([place[x] for x in some.column(0).to_pylist()], int), some.column(1).to_numpy()
            at = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[at], prepend=np.nan))
            blocks = {int(where[at][s]): who[at][s:e] for s, e in zip(cuts, [*cuts[1:], len(at)])}
        rows = index.rows.filter(F.col("block").isin(*blocks)) if len(blocks) <= 1000 else index.rows
        data = spark.sparkContext.broadcast((ids, q, blocks))
        return rows.select("block", "chunk_pos", "embedding").mapInArrow(_visit(data, index.metric, k, decimals), schema), sum(map(len, blocks.values())), whole

    ranked = W.partitionBy("query_id").orderBy("least", "block")
    before = F.coalesce(F.sum("n").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = stored(bounds.withColumn("before", before).filter(F.col("before") < k).select("query_id", "block"), "first")
    found, n_first, whole = visited(first)
    found = stored(found, "found")
    kth = F.element_at(F.slice(F.array_sort(F.collect_list("score")), 1, k), -1)
    worst = found.groupBy("query_id").agg(kth.alias("worst"), F.count(F.lit(1)).alias("held"))
    open_ = (F.col("held") < k) | (F.col("least") <= F.col("worst") + 10.0**-decimals)
    more = bounds.join(worst, "query_id", "left").filter(F.coalesce(open_, F.lit(True)) if not whole else F.lit(False)).select("query_id", "block").join(first, ["query_id", "block"], "left_anti")
    rest, n_rest, whole = visited(more)
    order = W.partitionBy("query_id").orderBy("score", "chunk_pos")
    done = (rest if whole else found.unionByName(rest)).withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= k)
    return done, {"pairs": bounds.count(), "visited": n_first + n_rest}


def search_all(index: VectorIndex, queries: DataFrame, k: int = 50, decimals: int = 9) -> DataFrame:
    """What ``search`` finds, for any number of questions: these meet the stored blocks in cells, and nothing of them passes the driver.

    In a cell, questions visit blocks by their bounds, and leave out those that cannot hold one of the best.
    """
    v = F.col("embedding").cast("array<double>").alias("embedding")
    asked = queries.select(F.lit(0).cast("long").alias("part"), F.col("query_id").cast("long").alias("query_id"), v).filter("query_id is not null and embedding is not null")
    rows = index.rows.select(F.col("block").alias("part"), "chunk_pos", "embedding")
    return retrieval.ranked(retrieval.meet_in_cells(rows, asked, k, index.metric, decimals, tiled=True), k, index.metric)
