import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding, ndcg, prompts, retrieval
from quillspark.plans import answer


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 6)).round(2)
    v[10] = v[11]
    v[12] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return v, spark.createDataFrame(rows, "chunk_pos long, embedding array<double>").repartition(4), spark.createDataFrame([(i, r) for i, r in rows if i % 5 == 0], "query_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_both_forms_equal_numpy(vectors, metric):
    v, chunks, queries = vectors
    key = ["query_id", "retrieval_rank"]
    a = [(r["query_id"], r["chunk_pos"], round(r["score"], 6)) for r in retrieval.top_k(chunks, queries, 7, metric).orderBy(*key).collect()]
    b = [(r["query_id"], r["chunk_pos"], round(r["score"], 6)) for r in retrieval.top_k_native(chunks, queries, 7, metric).orderBy(*key).collect()]
    want = []
    for q in range(0, 60, 5):
        if metric == "ip":
            s = -(v @ v[q])
        elif metric == "cosine":
            n = np.maximum(np.linalg.norm(v, axis=1), 1e-10)
            s = 1 - v @ v[q] / (n * n[q])
        else:
            s = ((v - v[q]) ** 2).sum(axis=1)
        for p in sorted(range(60), key=lambda i: (round(s[i], 9), i))[:7]:
            want.append((q, p, round(float(-s[p] if metric == "ip" else s[p]), 6)))
    near = lambda x: [(i, j) for i, j, _ in x]
    assert near(a) == near(b) == near(want)
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, want))


def test_more_queries_than_a_block(vectors, monkeypatch):
    _, chunks, queries = vectors
    one = sorted(map(tuple, retrieval.top_k(chunks, queries, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 13)
    assert sorted(map(tuple, retrieval.top_k(chunks, queries, 3).collect())) == one


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_a_task_holds_a_tile_of_products(metric):
    """2000 queries by a batch of 10,000 chunks are 160 MB of products, which no task may hold."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(2000, 16)) + 3, rng.normal(size=(10_000, 16)) + 3
    v[5000:] = v[:5000]  # equal scores, which go by position
    v[7], v[8] = np.nan, 1e30
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(v))], names=["chunk_pos", "embedding"])
    tracemalloc.start()
    got = pa.Table.from_batches(retrieval._local_top(SimpleNamespace(value=(np.arange(2000), q)), metric, 5, 6)([batch.slice(0, 6000), batch.slice(6000)])).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for i in (0, 511, 512, 1999):
        n = np.maximum(np.linalg.norm(v, axis=1), 1e-10) * np.linalg.norm(q[i])
        s = np.round({"ip": v @ q[i], "cosine": 1 - v @ q[i] / n, "l2": ((v - q[i]) ** 2).sum(axis=1)}[metric], 6)
        order = np.lexsort((np.arange(10_000), np.where(np.isnan(s), -np.inf, -s) if metric == "ip" else s))[:5]
        own = got[got["query_id"] == i].sort_values(["score", "chunk_pos"], ascending=[metric != "ip", True], na_position="first" if metric == "ip" else "last")[:5]
        assert own["chunk_pos"].tolist() == order.tolist()


def test_more_queries_than_are_broadcast_meet_in_cells(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(9000, 8)).astype(np.float32)
    v[:3000] = v[0]  # a very common vector
    chunks = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "chunk_pos long, embedding array<float>").repartition(6)
    found = retrieval.top_k(chunks, chunks.withColumnRenamed("chunk_pos", "query_id"), 4, "l2", 6)
    got = {}
    for r in found.filter("query_id % 1000 = 5").orderBy("query_id", "retrieval_rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_pos"], r["retrieval_rank"]))
    assert found.count() == 4 * 9000
    d = v.astype(float)
    for i in range(5, 9000, 1000):
        s = np.round(((d - d[i]) ** 2).sum(axis=1), 6)
        assert got[i] == [(int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(9000), s))[:4])]


def test_unknown_metric(vectors):
    with pytest.raises(ValueError):
        retrieval.top_k(vectors[1], vectors[2], metric="dot")


def test_rerank_is_stable(spark):
    d = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.9)], "query_id long, retrieval_rank int, cross_score double")
    assert [r["retrieval_rank"] for r in retrieval.rerank(d, 3).orderBy("rank").collect()] == [2, 4, 1]


def test_stand_in_scorers_agree(spark):
    rows = [("a b c", "B c d"), ("", ""), (None, "x"), ("x  x\ny", "y")]
    d = spark.createDataFrame(rows, "q string, p string")
    got = [r["cross_score"] for r in retrieval.with_cross_score(d, "q", "p").collect()]
    assert got == retrieval.token_overlap([r[0] for r in rows], [r[1] for r in rows])
    assert [r["cross_score"] for r in retrieval.with_cross_score(d, "q", "p", lambda q, p: [1.5] * len(q)).collect()] == [1.5] * 4


def test_length_mismatch_is_an_error(spark):
    a, b = spark.range(3).toDF("chunk_pos"), spark.range(4).toDF("chunk_pos").withColumn("embedding", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="differ in length"):
        retrieval.chunks_with_embeddings(a, b).collect()
    assert retrieval.chunks_with_embeddings(a, b.filter("chunk_pos < 3")).count() == 3


def dcg(gains, k):
    return sum(g / np.log2(i + 2) for i, g in enumerate(gains[:k]))


def test_ndcg(spark):
    rows = [(1, p, g) for p, g in [(0.9, 4), (0.5, 0), (0.5, 3), (0.5, 1), (0.1, 2)]] + [(2, 1.0, 0), (2, 0.5, 0), (3, 1.0, 4)]
    d = spark.createDataFrame(rows, "query_id long, predicted double, grade int")
    got = {(r["query_id"], r["k"]): r["ndcg"] for r in ndcg.ndcg(d, last_k=7).collect()}
    gains, best = [15, 11 / 3 - 1 + 0, 0, 0, 3], sorted((2**g - 1 for g in (4, 0, 3, 1, 2)), reverse=True)
    gains[1:4] = [(0 + 7 + 1) / 3] * 3
    for k in range(2, 8):
        assert abs(got[1, k] - dcg(gains, k) / dcg(best, k)) < 1e-12
        assert got[2, k] == 0 and got[3, k] is None
    s = {r["k"]: (r["mean"], r["std"], r["n"]) for r in ndcg.ndcg_summary(ndcg.ndcg(d, last_k=3)).collect()}
    assert s[2][2] == 2 and abs(s[2][0] - got[1, 2] / 2) < 1e-12 and abs(s[2][1] - got[1, 2] / 2) < 1e-12


def test_missing_grades_are_zero(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (1, 26)], "query_id long, cand_pos int")
    g = spark.createDataFrame([(1, 1, 3)], "query_id long, cand_pos int, grade int")
    assert sorted(r["grade"] for r in ndcg.with_grades(c, g).collect()) == [0, 0, 3]
    assert [(r["batch"], r["batch_pos"]) for r in ndcg.grading_batches(c).orderBy("cand_pos").collect()] == [(0, 1), (0, 2), (1, 1)]


def test_question_to_messages(spark):
    texts = ["davek na dobiček", "pravo vode", "dobiček iz kapitala"]
    none = F.lit(None).cast("string")
    chunks = embedding.embed(spark.createDataFrame(list(enumerate(texts)), "chunk_pos long, text string"), F.col("text"))
    chunks = chunks.withColumn("law_title", F.lit("Zakon")).withColumn("formatted_text", F.col("text")).withColumn("article_label", F.lit("1. člen")).withColumn("paragraph_number", none).withColumn("chunk_part", F.lit("1/2"))
    asked = embedding.embed(spark.createDataFrame([(7, "dobiček iz kapitala")], "query_id long, question string"), F.col("question"))
    history = prompts.history_of(spark.createDataFrame([(7, 1, "user", "prej"), (7, 2, "assistant", ""), (7, 3, "assistant", "da")], "query_id long, turn int, role string, text string"), conv="query_id")
    m = answer.prompts_for(chunks, asked, "Sistem", history, k=3, n=2).first()["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "system", "user"] and m[1]["content"] == "prej"
    assert m[3]["content"].startswith(prompts.CONTEXT_HEAD + "=== VIR [1] ===\nZAKON: Zakon\nČLEN: 1. člen\nDEL ČLENA: 1/2\n\nBESEDILO:\ndobiček iz kapitala\n\n=== KONEC VIRA [1] ===\n\n=== VIR [2] ===")


def test_embedding_of_nothing_is_zero(spark):
    d = embedding.embed(spark.createDataFrame([("a b",), ("",), (None,)], "t string"), F.col("t"))
    v = [r["embedding"] for r in d.collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-6 and set(v[1]) == set(v[2]) == {0.0}


def test_grades_of_batches(spark):
    rows = [(1, 0, 'Ocene: {"scores": [4, 0, 3]}'), (1, 1, '{"scores": [1,2,3,4]}'), (2, 0, "down"), (3, 0, None)]
    d = spark.createDataFrame(rows, "query_id long, batch int, reply string").withColumn("scores", ndcg.parse_scores(F.col("reply")))
    got = sorted(tuple(r) for r in ndcg.batch_grades(d, 3).collect())
    assert got == [(1, 1, 4), (1, 2, 0), (1, 3, 3), (1, 4, 1), (1, 5, 2), (1, 6, 3)]


def test_one_model_a_worker_in_row_order(spark, tmp_path):
    """Loads are noted in files, as workers are other processes; calls get texts of like length, rows keep their order."""
    import os

    import numpy as np

    notes, calls = str(tmp_path / "loads"), str(tmp_path / "calls")
    os.makedirs(notes)
    os.makedirs(calls)

    def load():
        open(f"{notes}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()

        def model(texts):
            with open(f"{calls}/{os.urandom(8).hex()}", "w") as f:
                f.write(f"{len(texts)} {max(map(len, texts)) - min(map(len, texts))}")
            return np.array([[len(t), sum(map(ord, t)) % 1000] for t in texts], dtype=np.float32)

        return model

    rows = [(k, "x" * (k * 37 % 101) + str(k) if k % 10 else ("" if k % 20 else None)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for _ in range(2):  # the second run finds the models of the first
            got = embedding.embed(df, F.col("t"), normalize=False, loader=load, model=str(tmp_path), batch=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r["embedding"] == ([float(len(r["t"])), float(sum(map(ord, r["t"])) % 1000)] if r["t"] else [0.0, 0.0]) for r in got) and len(got) == 1000
    pids = [x.split("-")[0] for x in os.listdir(notes)]
    assert 0 < len(pids) == len(set(pids))
    sizes = []
    for x in os.listdir(calls):
        with open(f"{calls}/{x}") as f:
            sizes.append(tuple(map(int, f.read().split())))
    assert sum(n == 16 for n, _ in sizes) > 0.7 * len(sizes)  # though Arrow batches have 7 rows
    assert sorted(d for _, d in sizes)[len(sizes) // 2] < 40

