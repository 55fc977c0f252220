import numpy as np
import pytest

from quillspark.operators import retrieval, vector_index


def clustered(spark, n=3000, clusters=30, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 5
    v = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * 0.05
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "chunk_pos long, embedding array<double>").repartition(4).cache()


def rows(df):
    return sorted((r["query_id"], r["retrieval_rank"], r["chunk_pos"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_equals_the_scan_and_leaves_blocks_out(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    chunks = clustered(spark)
    questions = chunks.filter("chunk_pos % 50 = 0").selectExpr("chunk_pos as query_id", "embedding")
    index = vector_index.build(chunks, str(tmp_path / "i"), metric)
    assert index.metric == metric and index.rows.count() == 3000 and index.blocks.agg({"n": "sum"}).first()[0] == 3000
    found, counts = vector_index.search(index, questions, 10, 6)
    assert rows(found) == rows(retrieval.top_k(chunks, questions, 10, metric, 6))
    assert counts["visited"] < 0.3 * counts["pairs"]
    again, _ = vector_index.search(vector_index.load(spark, str(tmp_path / "i")), questions, 10, 6)
    assert rows(again) == rows(found)
    monkeypatch.setattr(vector_index, "MOST_VISITS", 10)  # then all blocks are scanned
    scanned, counts = vector_index.search(index, questions, 10, 6)
    assert rows(scanned) == rows(found) and counts["visited"] == counts["pairs"]


def test_few_rows_ties_and_nulls(spark, tmp_path):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 1.0])]
    chunks = spark.createDataFrame(v, "chunk_pos long, embedding array<double>")
    index = vector_index.build(chunks, str(tmp_path / "i"), "cosine")
    questions = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    found, _ = vector_index.search(index, questions, 10, 6)
    assert rows(found) == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 3, 1.0), (1, 4, 4, 1.0)]
    assert vector_index.search(index, questions.filter("query_id = 2"), 10)[0].count() == 0
    with pytest.raises(ValueError):
        vector_index.build(chunks, str(tmp_path / "j"), "dot")
    empty = vector_index.build(chunks.filter("chunk_pos > 9"), str(tmp_path / "e"), "l2")
    assert vector_index.search(empty, questions, 10)[0].count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_more_questions_than_a_search_takes_meet_the_blocks_in_cells(spark, tmp_path, metric):
    chunks = clustered(spark, n=5000)
    questions = chunks.withColumnRenamed("chunk_pos", "query_id")
    found = vector_index.search_all(vector_index.build(chunks, str(tmp_path / "i"), metric), questions, 5, 6)
    assert rows(found) == rows(retrieval.top_k(chunks, questions, 5, metric, 6))
