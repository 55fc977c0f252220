"""Exact top-k inner-product search with two cover trees.

A cover tree is a sequence of nets: each holds the one before, its points lie further apart than its radius,
and every point lies within that radius of one of them. A walk from each point to the one farthest from all so far
yields all nets at once. The top of the tree over the table is such a net of a bounded sample; every row is then
dealt to its nearest net point, and a grouped maximum gives the true covering radius of each cell.

1. Each query first searches a block of its own cell. Its k-th score there is a lower bound of the true one.
2. A pair of a cell's queries and a cell is left out where centre product and covering radii cannot reach the worst
   such bound of the group, then single queries by their own bound. Only what is left is shuffled.
3. A task builds the cover tree of a block and of the queries that reached it, and walks both together: a
   pair of nodes is left out when its bound falls below the worst k-th score among the queries under it.

Blocks hold a bounded number of rows, so a cell with a very common vector is many blocks. A ranking over the
best k of each block is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, staged, trimmed

K, SCALE, QUERY_EVERY = 20, 64, 20
#: The net points of the top come from about this many rows, and from this share of them at most; they steer the work, never the result.
SAMPLE, SAMPLE_SHARE, PIVOTS = 4096, 0.125, 256
#: Vectors in a block (about); queries that a task holds at once.
BLOCK, QUERY_BLOCK = 4096, 2048
#: The radius of each net is that of the one before divided by this.
BASE = 1.3
#: Nodes of at most LEAF points, or whose children would hold fewer than FEW each, have no children; in trees of queries
#: the second numbers count, as a group of few queries has a bound of its own.
LEAF, FEW = (64, 4), (8, 2)
#: Stands for no score; smaller than all, and safe to negate.
LOWEST = -(1 << 63) + 1
#: Stands for a null id, which comes after all others.
NO_ID = (1 << 63) - 1
ROWS = "uid long, vec_id long, v binary, cell int, gap double, norm double, query boolean"
MET = "block int, query boolean, cell int, uid long, vec_id long, v binary, floor long"
FOUND = "uid long, query_id long, vec_id long, score long"


def quantise(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.asarray(v, dtype=np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while every sum fits the mantissa, then in 64-bit integers, then in unbounded ones."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x], dtype=object).reshape(x.shape)
    out = whole(a) @ whole(b).T
    if max(map(abs, out.ravel()), default=0) > NO_ID:
        raise OverflowError("an inner product exceeds a 64-bit integer")
    return out.astype(np.int64)


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


class Walk:
    """Farthest-point order over ``points``: chosen points, and for every point the nearest chosen one and its distance."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.chosen = [int(distances(points, points.mean(axis=0)).argmin())]
        self.gap, self.owner = distances(points, points[self.chosen[0]]), np.zeros(len(points), dtype=np.int64)

    def cover(self, radius: float, most: int) -> bool:
        """Add points until all lie within ``radius`` of a chosen one; False if that takes more than ``most``."""
        while (far := int(self.gap.argmax())) >= 0 and self.gap[far] > radius:
            if len(self.chosen) >= most:
                return False
            d = distances(self.points, self.points[far])
            closer = d < self.gap
            self.gap[closer], self.owner[closer] = d[closer], len(self.chosen)
            self.chosen.append(far)
        return True


class Node:
    """The points ``rows`` within ``radius`` of the point ``at``; ``low`` is the worst k-th score below a query node."""

    __slots__ = ("at", "centre", "rows", "radius", "norm", "most", "children", "low", "centres", "radii", "norms", "mosts")

    def __init__(self, points: np.ndarray, at: int, rows: np.ndarray, children: list[Node], kind: int = 0) -> None:
        self.at, self.centre, self.rows = at, points[at], rows
        self.children = children if len(rows) > LEAF[kind] and len(children) > 1 and len(rows) >= FEW[kind] * len(children) else []
        self.radius = float(distances(points[rows], self.centre).max())
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.most = float(np.sqrt((points[rows] ** 2).sum(axis=1).max()))
        self.low = LOWEST
        if self.children:
            self.centres = np.array([c.centre for c in self.children])
            self.radii, self.norms, self.mosts = (np.array([getattr(c, x) for c in self.children]) for x in ("radius", "norm", "most"))


def nets(points: np.ndarray, kind: int = 0) -> tuple[list[tuple[float, int, np.ndarray]], list[int]]:
    """(radius, number of net points, nearest net point of every point) of each net, widest first, and the farthest-point order."""
    walk = Walk(points)
    radius = float(walk.gap.max())
    out = [(radius, 1, walk.owner.copy())]
    while radius > 0 and walk.gap.max() > 0:
        radius /= BASE
        if not walk.cover(radius, max(1, len(points) // FEW[kind])):
            break
        if len(walk.chosen) > out[-1][1]:
            out.append((radius, len(walk.chosen), walk.owner.copy()))
    return out, walk.chosen


def cover_tree(points: np.ndarray, kind: int = 0) -> Node:
    """The tree over all levels of nets; ``kind`` is 1 for queries."""
    levels, chosen = nets(points, kind)
    _, size, owner = levels[-1]
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, size))
    below = [Node(points, chosen[c], rows, [], kind) for c, rows in enumerate(np.split(order, cuts))]
    for _, size, owner in reversed(levels[:-1]):
        families: list[list[Node]] = [[] for _ in range(size)]
        for n in below:
            families[owner[n.at]].append(n)  # a net point is its own nearest, so nets stay nested
        below = [f[0] if len(f) == 1 else Node(points, chosen[c], np.concatenate([n.rows for n in f]), f, kind) for c, f in enumerate(families)]
    return below[0]


def bounds(centre: np.ndarray, radius: float, norm: float, most: float, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray, mosts: np.ndarray) -> np.ndarray:
    """No product of a point of the one ball and a point of another is larger: by the radii around the centres'
    product, and by the least distance of the balls. A hair is added for the rounding of floating point."""
    product = centres @ centre
    by_radius = product + radius * norms + radii * norm + radius * radii
    apart = np.maximum(0.0, np.sqrt(np.maximum(0.0, norm**2 + norms**2 - 2 * product)) * (1 - 1e-7) - radius - radii - 1e-6 * (norm + norms))
    by_distance = (most**2 + mosts**2 - apart**2) / 2
    scale = (norm + radius) * (norms + radii)
    return np.minimum(by_radius, by_distance) + 1e-9 * (scale + most**2 + mosts**2) + 1e-6


class Best:
    """The best k of each query: scores descending, equal scores by id. Scores are 64-bit integers."""

    def __init__(self, uids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.uids, self.k, self.floor = uids, k, floor.astype(np.int64)
        self.score = np.full((len(uids), k), LOWEST, dtype=np.int64)
        self.found = np.full((len(uids), k), NO_ID, dtype=np.int64)
        self.n = np.zeros(len(uids), dtype=np.int64)

    def low(self, rows: np.ndarray) -> int:
        return int(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def add(self, rows: np.ndarray, uids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        fits = score >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]
        fits &= self.uids[rows][:, None] != uids[None, :]
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            at, r = np.flatnonzero(fits[i]), rows[i]
            s = np.concatenate([self.score[r, : self.n[r]], score[i, at]])
            d = np.concatenate([self.found[r, : self.n[r]], ids[at]])
            order = np.lexsort((d, -s))[: self.k]
            self.n[r] = len(order)
            self.score[r, : len(order)], self.found[r, : len(order)] = s[order], d[order]


def dual_search(queries: np.ndarray, best: Best, tree: Node, points: np.ndarray, uids: np.ndarray, ids: np.ndarray) -> None:
    """Walk the trees of queries and points together; pairs of nodes below the worst k-th score are left out."""
    root = cover_tree(queries, 1)

    def refresh(q: Node) -> None:
        q.low = min(c.low for c in q.children) if q.children else best.low(q.rows)

    def begin(q: Node) -> None:
        for c in q.children:
            begin(c)
        refresh(q)

    def walk(q: Node, p: Node) -> None:
        if not q.children and not p.children:
            best.add(q.rows, uids[p.rows], ids[p.rows], products(queries[q.rows], points[p.rows]))
            refresh(q)
        elif p.children and (not q.children or p.radius >= q.radius):
            b = bounds(q.centre, q.radius, q.norm, q.most, p.centres, p.radii, p.norms, p.mosts)
            for k in np.argsort(-b).tolist():
                if b[k] < q.low:
                    break
                walk(q, p.children[k])
        else:
            b = bounds(p.centre, p.radius, p.norm, p.most, q.centres, q.radii, q.norms, q.mosts)
            for k, c in enumerate(q.children):
                if b[k] >= c.low:
                    walk(c, p)
            refresh(q)

    begin(root)
    walk(root, tree)


def _vectors(blobs: list[bytes]) -> np.ndarray:
    width = max(map(len, blobs), default=0) // 8
    out = np.zeros((len(blobs), width))
    for k, b in enumerate(blobs):
        out[k, : len(b) // 8] = np.frombuffer(b, dtype="<f8")
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) if x.shape[1] < w else x for x in (a, b))


def _deal(top, query_every: int):
    """Quantised rows with their cell, the distance to its centre and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            if not b.num_rows:
                continue
            blobs = [quantise(v.values.to_numpy(zero_copy_only=False)).astype("<f8").tobytes() for v in b.column(1)]
            points, pivots = _same_width(_vectors(blobs), top.value)
            cell = (points @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1)
            gap = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(1).to_numpy()
            cols = [np.arange(uid, uid + len(ids)), b.column(0), pa.array(blobs, pa.binary()), cell.astype(np.int32), gap, np.sqrt((points**2).sum(axis=1)), known & (ids % query_every == 0)]
            uid += len(ids)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def _ask(top, layout):
    """A row for each query and each block that its bound may reach, but for the block it has searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first, parts, radii, mosts = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            queries, pivots = _same_width(_vectors(b.column(2).to_pylist()), top.value)
            cell, floor, home, norm = (b.column(c).to_numpy() for c in ("cell", "floor", "home", "norm"))
            norms = np.sqrt((pivots**2).sum(axis=1))
            row, block = [], []
            for i in range(len(queries)):
                near = bounds(queries[i], 0.0, float(norm[i]), float(norm[i]), pivots, radii, norms, mosts) >= floor[i]
                to = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(near & open_[cell[i]])] or [np.zeros(0, dtype=np.int64)])
                to = to[to != home[i]]
                row.append(np.full(len(to), i))
                block.append(to)
            for k in range(0, len(row), 64):  # few queries at a time: each may reach very many blocks
                r, t = np.concatenate(row[k : k + 64]).astype(np.int64), np.concatenate(block[k : k + 64]).astype(np.int32)
                if len(r):
                    picked = b.take(pa.array(r))
                    cols = [pa.array(t), pa.array(np.ones(len(r), dtype=bool)), *(picked.column(c) for c in ("cell", "uid", "vec_id", "v", "floor"))]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in MET.split(", ")])

    return run


def _search(k: int):
    """Rows come block by block, its vectors before its queries; queries are searched so many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tree, points, uids, ids = None, None, None, None, None
        held: list[tuple] = []
        asking = False

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal tree, points, uids, ids
            if not held:
                return
            own, named = np.array([r[0] for r in held], dtype=np.int64), np.array([NO_ID if r[1] is None else r[1] for r in held], dtype=np.int64)
            v = _vectors([r[2] for r in held])
            if not asking:
                points, uids, ids, tree = v, own, named, None
            elif points is not None:
                v, p = _same_width(v, points)
                if tree is None or p.shape[1] != points.shape[1]:
                    points, tree = p, cover_tree(p)
                best = Best(own, np.array([r[3] for r in held]), k)
                dual_search(v, best, tree, points, uids, ids)
                keep = np.arange(k)[None, :] < best.n[:, None]
                found = best.found[keep]
                cols = [pa.array(np.repeat(own, best.n)), pa.array(np.repeat(named, best.n)), pa.array(found, mask=found == NO_ID), pa.array(best.score[keep])]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "query_id", "vec_id", "score"])
            held.clear()

        for b in batches:
            for blk, query, i, d, v, low in zip(*(b.column(c).to_pylist() for c in ("block", "query", "uid", "vec_id", "v", "floor"))):
                if (blk, query) != (block, asking) or query and len(held) >= QUERY_BLOCK:
                    yield from finish()
                    if blk != block:
                        points = tree = None
                    block, asking = blk, query
                held.append((i, d, v, low))
        yield from finish()

    return run


def _met(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    parts = partitions(data.sparkSession)
    met = data.unionByName(asked).repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block", "query", "cell", "uid")
    return met.mapInArrow(trimmed(_search(k)), FOUND)


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """The net points of the top: the first of the farthest-point order over the sample, one for each block of the table at most."""
    if not len(sample):
        return np.zeros((1, 1))
    walk = Walk(sample)
    walk.cover(0.0, max(1, min(PIVOTS, n // BLOCK)))
    return sample[walk.chosen]


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row whose id divides by ``query_every``.

    Components become floor(64 * x); the score is the integer inner product, and one beyond 64 bits is an error;
    equal scores go to the smaller id, null ids last. Null vectors, vectors with null or non-finite components
    and empty vectors take no part. A row without id is a candidate and no query. Rows that repeat an id are
    candidates and queries each; only the very row is not its own neighbour. A shorter vector counts as
    padded with zeros. An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).filter("size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n = rows.count()
    seen = rows.sample(min(SAMPLE_SHARE, sample / max(1, n)), 13).select("v").toArrow().column(0).to_pylist()
    top = spark.sparkContext.broadcast(pivots_of(_vectors([quantise(v).tobytes() for v in seen]), n))
    dealt = staged(rows.mapInArrow(trimmed(_deal(top, query_every)), ROWS), "vectors")

    cells = len(top.value)
    radii, mosts, reach, parts, asking = np.zeros(cells), np.zeros(cells), np.zeros(cells), np.ones(cells, dtype=np.int64), np.zeros(cells)
    own_gap, one = F.when(F.col("query"), F.col("gap")), F.count(F.lit(1))
    for r in dealt.groupBy("cell").agg(one.alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("most"), F.max(own_gap).alias("reach"), F.max(F.when(F.col("query"), F.col("norm"))).alias("asking")).collect():
        c = r["cell"]
        radii[c], mosts[c], reach[c], asking[c], parts[c] = r["radius"], r["most"], r["reach"] or 0.0, r["asking"] or 0.0, -(-r["n"] // BLOCK)
    first = np.cumsum(parts) - parts
    table = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(cells)], "cell int, first int, parts int"))
    block = (F.col("first") + F.pmod(F.xxhash64("uid", F.lit(2)), F.col("parts"))).cast("int")
    placed = dealt.join(table, "cell").withColumn("home", block)
    none = F.lit(LOWEST).cast("long")
    data = placed.select(F.col("home").alias("block"), F.lit(False).alias("query"), "cell", "uid", "vec_id", "v", none.alias("floor"))
    asked = placed.filter("query")
    nearest = staged(_met(data, asked.select(F.col("home").alias("block"), "query", "cell", "uid", "vec_id", "v", none.alias("floor")), k), "nearest")

    floors = nearest.groupBy("uid").agg(F.when(one >= k, F.min("score")).otherwise(none).alias("floor"))
    asked = staged(asked.join(floors, "uid", "left").select("uid", "vec_id", "v", "cell", "norm", "home", F.coalesce("floor", none).alias("floor")), "asked")
    lows = np.full(cells, np.inf)
    for r in asked.groupBy("cell").agg(F.min("floor").alias("low")).collect():
        lows[r["cell"]] = r["low"]
    pivots = top.value
    norms = np.sqrt((pivots**2).sum(axis=1))
    open_ = np.array([bounds(pivots[c], reach[c], norms[c], asking[c], pivots, radii, norms, mosts) >= lows[c] for c in range(cells)])
    layout = spark.sparkContext.broadcast((open_, first, parts, radii, mosts))
    reached = asked.mapInArrow(trimmed(_ask(top, layout)), MET)
    found = nearest.unionByName(_met(data, reached, k))
    order = W.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
