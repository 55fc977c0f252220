import math

import numpy as np
import pytest

from quillspark.llm import topk as op


def brute(rows, k, every):
    vecs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (q, own) in enumerate(vecs):
        if q is not None and q % every == 0:
            s = sorted((-dot(own, v), i is None, i or 0) for other, (i, v) in enumerate(vecs) if other != at)[:k]
            out += [(q, r + 1, None if null else i, -x) for r, (x, null, i) in enumerate(s)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def test_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(4)
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in df.collect()]
    assert rows_of(op.top_k(df)) == brute(rows, 20, 20)


def test_clustered_vectors_ties_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(int(i), (centres[i % 6] + rng.normal(size=8) * 0.05).round(2).tolist()) for i in range(2500)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]  # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(op, "BLOCK", 200)
    assert rows_of(op.top_k(df, sample=100)) == brute(rows, 20, 20)


def test_nets_of_the_tree():
    """Nets are nested by order, keep their points apart and cover all points; nodes cover what is below them."""
    rng = np.random.default_rng(5)
    points = op.quantise(np.concatenate([rng.normal(size=(700, 5)), rng.normal(size=(300, 5)) * 0.02 + 4, np.ones((50, 5))]))
    levels, chosen = op.nets(points)
    assert len(levels) > 4
    for radius, size, owner in levels:
        net = points[chosen[:size]]
        gaps = np.sqrt(((net[:, None] - net[None]) ** 2).sum(axis=2)) + 1e9 * np.eye(size)
        assert size == 1 or gaps.min() > radius
        assert (op.distances(points, net[owner]) <= radius + 1e-9).all()
    tree = op.cover_tree(points)
    assert sorted(tree.rows) == list(range(len(points)))

    def visit(n):
        assert (op.distances(points[n.rows], n.centre) <= n.radius + 1e-9).all()
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
        return 1 + sum(map(visit, n.children))

    assert visit(tree) > 10


def test_nodes_are_left_out(monkeypatch):
    rng = np.random.default_rng(5)
    points = op.quantise(np.concatenate([rng.normal(size=(600, 64)) * 0.02 + c for c in np.eye(64)[:6] * 3]))
    n, calls, plain = len(points), [], op.products
    monkeypatch.setattr(op, "products", lambda a, b: calls.append(len(a) * len(b)) or plain(a, b))
    best = op.Best(np.arange(50), np.full(50, op.LOWEST), 5)
    op.dual_search(points[:50], best, op.cover_tree(points), points, np.arange(n), np.arange(n))
    s = points[:50] @ points.T
    s[np.arange(50), np.arange(50)] = -1e9
    assert (best.score == -np.sort(-s, axis=1)[:, :5]).all()
    assert sum(calls) < 50 * n / 4


def test_cells_are_left_out_before_the_shuffle(spark, monkeypatch):
    """On clustered vectors, with a sample far below the table, most pairs of query and block are never dealt."""
    monkeypatch.setattr(op, "BLOCK", 100)
    rng = np.random.default_rng(8)
    centres = np.eye(64)[:20] * 2
    rows = [(i, (centres[i % 20] + rng.normal(size=64) * 0.02).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    seen, plain = [], op._met
    monkeypatch.setattr(op, "_met", lambda data, asked, k: seen.append((data.select("block").distinct().count(), asked.count())) or plain(data, asked, k))
    got = rows_of(op.top_k(df, sample=200, query_every=19))
    (blocks, queries), (_, pairs) = seen
    assert blocks >= 40 and pairs < queries * blocks / 4
    vecs = op.quantise([v for _, v in rows])
    s = (vecs[::19] @ vecs.T).astype(int)
    for k in range(len(s)):
        s[k, 19 * k] = -(10**9)
    want = [(19 * k, r + 1, int(i), int(s[k, i])) for k in range(len(s)) for r, i in enumerate(np.lexsort((np.arange(4000), -s[k]))[:20])]
    assert got == sorted(want, key=str)


def test_large_scores_are_exact(spark):
    rows = [(0, [134217729 / 64, 3 / 64]), (1, [134217731 / 64, 5 / 64]), (2, [134217731 / 64, 4 / 64]), (3, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(op.top_k(df, query_every=20))
    assert got == brute(rows, 20, 20) and got[0] == (0, 1, 1, 134217729 * 134217731 + 15)
    for size in (2.0**20, 2.0**30, 2.0**31 - 1):
        a = np.array([[size, 1.0], [size - 3, 7.0], [-size, 5.0]])
        assert op.products(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in a] for p in a]
    with pytest.raises(OverflowError):
        op.products(np.array([[2.0**32]]), np.array([[2.0**32]]))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0, 3.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1e6, -1e6]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0]), (9, [2.0, 2.0]), (9, [1.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert rows_of(op.top_k(df)) == brute(rows, 20, 20)
    assert op.top_k(df.limit(0)).count() == 0
    assert rows_of(op.top_k(df.filter("vec_id = 0"))) == []
