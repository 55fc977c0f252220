"""Exact batch retrieval: top-k by inner product, cosine distance or squared distance, then a pluggable rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.vectors import LEAST_NORM, cosine_distance, dot, squared_l2

#: Queries of at most so many rows are broadcast; more are dealt to groups, each of which meets every block of chunks.
QUERY_BLOCK, QUERY_GROUP = 4096, 65_536
#: Chunks of a block at most, and components (of long vectors a block has fewer).
CHUNK_BLOCK, BLOCK_VALUES = 131_072, 1 << 23
#: Queries and chunks of one product, and components that are gathered at once for exact scores.
TILE_QUERIES, TILE_CHUNKS, EXACT_VALUES = 512, 4096, 1 << 21
#: Rounding of single precision, and the length from which vectors are not met in it.
UNIT, WILD = 2.0**-24, 1e18
#: What rounding in double precision may take from a bound of a tile.
SLACK = 1e-9
#: Ascending metrics.
DISTANCES = {"cosine", "l2"}
Scorer = Callable[[list[str], list[str]], list[float]]


def score(metric: str, a: Column, b: Column) -> Column:
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "l2":
        return squared_l2(a, b)
    raise ValueError(f"unknown metric: {metric}")


def _matrix(c) -> np.ndarray:
    n = len(c)
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _rows(c) -> np.ndarray:
    """The vectors of a list column as they are, in single or double precision."""
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _near(metric: str, x: np.ndarray, origin: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in single precision, whose products with those of the other side grow as chunks get better, their sizes, and what
    squared distances add to the product. Rows too large for that are NaN, as is every product with them."""
    with np.errstate(all="ignore"):
        x, base = x.astype(np.float64), np.zeros(len(x))
        if metric == "cosine":
            x /= np.maximum(_sizes(x), LEAST_NORM)[:, None]
        elif metric == "l2":
            x -= origin
            base = np.einsum("ij,ij->i", x, x)
            x = np.column_stack([2 * x, np.full(len(x), -1.0)] if asked else [x, base])
        size = _sizes(x)
        wild = ~(size < WILD)
        x = x.astype(np.float32)
    x[wild], size[wild] = np.nan, 0.0
    return x, size, base


class _Chunks:
    """A block of chunks. ``parts``, where given, rises and names tiles of near chunks, which are bounded by a ball."""

    def __init__(self, metric: str, pos: np.ndarray, v: np.ndarray, parts: np.ndarray | None = None):
        self.metric, self.pos, self.v = metric, pos, v
        # Any origin gives the same distances; one amid the chunks keeps their products small, and so the error of these.
        some = v[:: max(1, len(v) // 1024)] if metric == "l2" else v[:0]
        some = some[np.isfinite(some).all(axis=1)]
        self.origin = np.median(some, axis=0).astype(np.float64) if len(some) else np.zeros(v.shape[1])
        self.near, self.size, _ = _near(metric, v, self.origin, False)
        cuts = [0, len(pos)] if parts is None else [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(pos)]
        self.tiles = [(s, min(s + TILE_CHUNKS, b)) for a, b in zip(cuts, cuts[1:]) for s in range(a, b, TILE_CHUNKS)]
        self.balls = None if parts is None else self._balls()

    def _balls(self) -> tuple[np.ndarray, np.ndarray]:
        """Centre and radius of each tile, of unit vectors for cosine; a radius that is no number bounds nothing."""
        centres, radii = np.zeros((len(self.tiles), self.v.shape[1])), np.zeros(len(self.tiles))
        with np.errstate(all="ignore"):
            for t, (a, b) in enumerate(self.tiles):
                x = self.placed(self.v[a:b])
                centres[t] = x.mean(axis=0)
                radii[t] = _sizes(x - centres[t]).max()
        return centres, radii

    def placed(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return x / np.maximum(_sizes(x), LEAST_NORM)[:, None] if self.metric == "cosine" else x - self.origin

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and tile, what its products can reach at most."""
        centres, radii = self.balls
        with np.errstate(all="ignore"):
            x = self.placed(q)
            s = x @ centres.T
            if self.metric != "l2":
                return s + _sizes(x)[:, None] * radii + SLACK
            own = np.einsum("ij,ij->i", x, x)[:, None]
            far = np.sqrt(np.maximum(own + np.einsum("ij,ij->i", centres, centres) - 2 * s, 0.0))
            return own - np.maximum(far * (1 - SLACK) - radii * (1 + SLACK) - SLACK, 0.0) ** 2 + SLACK * (1 + own)


class _Top:
    """The k best so far of some queries: rows of them by query, score and position.

    Products in single precision only tell which chunks cannot be among the best, by a bound of their error; the others are scored in
    double precision. What is held at once is a tile of products and as many rows.
    """

    def __init__(self, metric: str, k: int, decimals: int, ids: np.ndarray, q: np.ndarray):
        self.metric, self.k, self.decimals, self.ids, self.q = metric, k, decimals, ids, q
        self.row, self.pos, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(q), np.inf if metric in DISTANCES else -np.inf)

    def meet(self, chunks: _Chunks) -> None:
        near, size, base = _near(self.metric, self.q, chunks.origin, True)
        unit, tiles, bounds = 10.0**-self.decimals, range(len(chunks.tiles)), None
        if chunks.balls is not None:
            bounds = chunks.bounds(self.q)
            tiles = np.argsort(-np.nan_to_num(bounds, nan=np.inf).mean(axis=0), kind="stable").tolist()
        for t in tiles:
            start, stop = chunks.tiles[t]
            margin = 4 * (near.shape[1] + 4) * UNIT * size * chunks.size[start:stop].max(initial=0.0) + unit
            limit = {"ip": self.worst, "cosine": 1 - self.worst, "l2": base - self.worst}[self.metric] - margin
            own = np.arange(len(self.q)) if bounds is None else np.flatnonzero(~(bounds[:, t] + margin < limit))
            if not len(own):
                continue
            products = near[own] @ chunks.near[start:stop].T
            limit = limit[own]
            if stop - start > self.k and len(first := np.flatnonzero(np.isneginf(limit))):
                some = products[first]
                some[np.isnan(some)] = -np.inf
                limit[first] = np.partition(some, stop - start - self.k, axis=1)[:, stop - start - self.k] - 2 * margin[own][first]
            with np.errstate(over="ignore"):
                low = np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
            hit = np.flatnonzero(~(products < low[:, None]))
            if len(hit):
                i, j = own[hit // (stop - start)], hit % (stop - start) + start
                self._add(i, chunks.pos[j], self._exact(i, chunks.v, j))

    def _exact(self, i: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(i)), max(1, EXACT_VALUES // max(1, v.shape[1]))
        with np.errstate(all="ignore"):
            for s in range(0, len(i), step):
                a, b = self.q[i[s : s + step]].astype(np.float64), v[j[s : s + step]].astype(np.float64)
                if self.metric == "l2":
                    out[s : s + step] = np.einsum("ij,ij->i", a - b, a - b)
                    continue
                dots = np.einsum("ij,ij->i", a, b)
                out[s : s + step] = dots if self.metric == "ip" else 1.0 - dots / (np.maximum(_sizes(a), LEAST_NORM) * np.maximum(_sizes(b), LEAST_NORM))
            return np.round(out, self.decimals) + 0.0

    def _add(self, row: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        row, pos, score = np.concatenate([self.row, row]), np.concatenate([self.pos, pos]), np.concatenate([self.score, score])
        # NaN counts as the greatest number, as it does where the ranks are made.
        order = np.lexsort((pos, score if self.metric in DISTANCES else np.where(np.isnan(score), -np.inf, -score), row))
        sorted_ = row[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        order, place = order[place < self.k], place[place < self.k]
        self.row, self.pos, self.score = row[order], pos[order], score[order]
        last = place == self.k - 1
        self.worst[self.row[last]] = self.score[last]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.pos), pa.array(self.score)], names=["query_id", "chunk_pos", "score"])


def _slices(n: int) -> Iterator[slice]:
    return (slice(s, s + TILE_QUERIES) for s in range(0, n, TILE_QUERIES))


def _best(metric: str, k: int, decimals: int, ids: np.ndarray, q: np.ndarray, chunks: _Chunks) -> Iterator[pa.RecordBatch]:
    """The k best of the chunks for each query, some queries at a time."""
    for own in _slices(len(ids)):
        top = _Top(metric, k, decimals, ids[own], q[own])
        top.meet(chunks)
        yield top.batch()


def _local_top(held, metric: str, k: int, decimals: int):
    """All chunks of a task against all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        tops = [_Top(metric, k, decimals, ids[own], q[own]) for own in _slices(len(ids))]
        for b in batches:
            if b.num_rows and tops:
                chunks = _Chunks(metric, b.column(0).to_numpy(), _rows(b.column(1)))
                for top in tops:
                    top.meet(chunks)
        for top in tops:
            yield top.batch()

    return run


def _cell_top(metric: str, k: int, decimals: int, tiled: bool):
    """Rows (cell, query, part, id, embedding) come cell by cell, chunks before queries, either by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, chunks = None, [], None
        for b in batches:
            kind = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)], axis=1)
            cuts = np.flatnonzero((kind[1:] != kind[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)]):
                if start == stop:
                    continue
                if kind[start, 0] != cell:
                    cell, held, chunks = kind[start, 0], [], None
                part, ids, v = b.column(2)[start:stop].to_numpy(), b.column(3)[start:stop].to_numpy(), _rows(b.column(4)[start:stop])
                if not kind[start, 1]:
                    held.append((part, ids, v))
                elif held or chunks:
                    if chunks is None:
                        parts, pos, all_ = map(np.concatenate, zip(*held))
                        held, chunks = [], _Chunks(metric, pos, all_, parts if tiled else None)
                    yield from _best(metric, k, decimals, ids, v, chunks)

    return run


def _vector_type(*frames: DataFrame) -> str:
    """Single precision where all vectors are given in it."""
    return "array<float>" if all(f.schema["embedding"].dataType.simpleString() == "array<float>" for f in frames) else "array<double>"


def meet_in_cells(rows: DataFrame, asked: DataFrame, k: int, metric: str, decimals: int, tiled: bool = False) -> DataFrame:
    """query_id, chunk_pos, score: the k best of each query in each block of chunks, for any number of either.

    ``rows`` has part, chunk_pos, embedding, ``asked`` part, query_id, embedding. Chunks are dealt to blocks by part (else by position) and queries to
    groups; each pair of block and group is a cell that one task scores in tiles, so a vector is sent as often as the other side has
    blocks or groups and no task holds more than a block. ``tiled`` parts are balls of near chunks: what their bound excludes is not scored.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n_asked, cores = asked.count(), spark.sparkContext.defaultParallelism
    side = int(np.ceil(np.sqrt(2 * cores)))
    most = max(1, min(CHUNK_BLOCK, BLOCK_VALUES // max(1, size["d"] or 1)))
    blocks = max(1, -(-size["n"] // most), min(side, size["n"] // TILE_CHUNKS))
    groups = max(1, -(-n_asked // QUERY_GROUP), min(side, n_asked // TILE_QUERIES))
    block = F.pmod(F.xxhash64("part" if tiled else "chunk_pos"), F.lit(blocks))
    group = F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = rows.select("*", every(groups).alias("_g")).select((block * groups + F.col("_g")).alias("cell"), F.lit(False).alias("query"), "part", F.col("chunk_pos").alias("id"), "embedding")
    sent = asked.select("*", every(blocks).alias("_b")).select((F.col("_b") * groups + group).alias("cell"), F.lit(True).alias("query"), "part", F.col("query_id").alias("id"), "embedding")
    parts = min(blocks * groups, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = data.unionByName(sent).repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", "query", "part")
    return met.mapInArrow(_cell_top(metric, k, decimals, tiled), "query_id long, chunk_pos long, score double")


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    best = F.asc("score") if metric in DISTANCES else F.desc("score")
    order = W.partitionBy("query_id").orderBy(best, "chunk_pos")
    return found.withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= k)


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 50, metric: str = "ip", decimals: int = 9) -> DataFrame:
    """query_id, chunk_pos, score, retrieval_rank (from 1): the k best chunks of each query.

    ``chunks`` has chunk_pos and embedding, ``queries`` query_id and embedding, all of one dimension. Scores are
    summed in double precision, rounded to ``decimals``; equal ones go by chunk_pos. Few queries are broadcast and meet the
    chunks where they are; many meet blocks of chunks in cells. Either way a task holds a block, a tile of products and
    its own best k, and hands on k rows a query.
    """
    if metric not in {"ip", *DISTANCES}:
        raise ValueError(f"unknown metric: {metric}")
    spark, kind = chunks.sparkSession, _vector_type(chunks, queries)
    rows = chunks.select(F.col("chunk_pos").cast("long").alias("chunk_pos"), F.col("embedding").cast(kind).alias("embedding")).filter("chunk_pos is not null and embedding is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast(kind).alias("embedding")).filter("query_id is not null and embedding is not null")
    if asked.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        t = asked.toArrow()
        held = spark.sparkContext.broadcast((t.column(0).to_numpy(), _rows(t.column(1).combine_chunks())))
        found = rows.mapInArrow(_local_top(held, metric, k, decimals), "query_id long, chunk_pos long, score double")
    else:
        whole = F.lit(0).cast("long").alias("part")
        found = meet_in_cells(rows.select(whole, "*"), asked.select(whole, "*"), k, metric, decimals)
    return ranked(found, k, metric)


def top_k_native(chunks: DataFrame, queries: DataFrame, k: int = 50, metric: str = "ip", decimals: int = 9) -> DataFrame:
    """The same by expressions alone, for small query sets and as a cross-check."""
    pairs = chunks.select("chunk_pos", F.col("embedding").alias("_v")).join(F.broadcast(queries.select("query_id", F.col("embedding").alias("_q"))), F.lit(True))
    pairs = pairs.select("query_id", "chunk_pos", F.round(score(metric, F.col("_v"), F.col("_q")), decimals).alias("score"))
    best = F.asc("score") if metric in DISTANCES else F.desc("score")
    order = W.partitionBy("query_id").orderBy(best, "chunk_pos")
    return pairs.withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= k)


def rerank_text(law_title: Column, text: Column, formatted: Column, mode: str = "online") -> Column:
    """What the reranker reads: title and text online, the formatted text (else the text) in evaluation."""
    if mode == "online":
        return F.concat(F.coalesce(law_title, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))
    return F.coalesce(F.nullif(formatted, F.lit("")), text, F.lit(""))


def token_overlap(questions: list[str], passages: list[str]) -> list[float]:
    """A stand-in scorer, not a model: Jaccard similarity of lower-case word sets."""
    out = []
    for q, p in zip(questions, passages):
        a, b = set((q or "").lower().split()), set((p or "").lower().split())
        out.append(len(a & b) / len(a | b) if a | b else 0.0)
    return out


def overlap_expression(question: Column, passage: Column) -> Column:
    """``token_overlap`` as an expression, for texts whose white space is ASCII."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\n\x0b\f\r]+"), lambda x: x != ""))
    a, b = words(question), words(passage)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def with_cross_score(candidates: DataFrame, question: str, passage: str, scorer: Scorer | None = None) -> DataFrame:
    """Adds cross_score; a scorer gets Arrow batches of texts, without one the stand-in expression is used."""
    if scorer is None:
        return candidates.withColumn("cross_score", overlap_expression(F.col(question), F.col(passage)))
    import pandas as pd

    run = F.pandas_udf(lambda q, p: pd.Series(scorer(q.tolist(), p.tolist()), dtype="float64"), "double")
    return candidates.withColumn("cross_score", run(question, passage))


def rerank(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n best of each query by cross_score; equal ones keep their retrieval order."""
    order = W.partitionBy("query_id").orderBy(F.desc("cross_score"), "retrieval_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def as_candidates(found: DataFrame) -> DataFrame:
    """query_id and the eight fields that evaluation reads of a retrieved chunk, nearest first in each query's ranks.

    A formatted text that is missing or empty is the text; a chunk without an id is named by its position; columns that
    ``found`` does not have are empty.
    """
    own = lambda c: F.col(c) if c in found.columns else F.lit("")
    text = F.coalesce(own("text"), F.lit(""))
    name = F.col("chunk_id") if "chunk_id" in found.columns else F.col("chunk_pos").cast("string")
    rest = [own(c).alias(c) for c in ("law_title", "law_code", "article_label", "article_heading")]
    return found.select("query_id", "retrieval_rank", text.alias("text"), F.coalesce(F.nullif(own("formatted_text"), F.lit("")), text).alias("formatted_text"), F.col("score").alias("dist"), name.alias("chunk_id"), *rest)


def chunks_with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The one-to-one join on chunk_pos; a row without partner on either side raises when the result is read."""
    both = chunks.withColumn("_c", F.lit(True)).join(embeddings.withColumn("_e", F.lit(True)), "chunk_pos", "full")
    fits = F.assert_true(F.col("_c").isNotNull() & F.col("_e").isNotNull(), F.lit("chunks and embeddings differ in length"))
    return both.filter(fits.isNull()).drop("_c", "_e")
