import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import result_file_name
from quillspark.operators import judging
from quillspark.plans import answer
from quillspark.sources import readers, sinks


def test_store_prunes_by_law(spark, tmp_path):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "chunk_pos long, law_code string")
    sinks.write_store(df, str(tmp_path / "store"), "law_code")
    back = spark.read.parquet(str(tmp_path / "store"))
    assert sorted(r["chunk_pos"] for r in back.collect()) == [1, 2, 3]
    assert "PartitionFilters: [isnotnull(law_code" in back.filter("law_code = 'A'")._jdf.queryExecution().executedPlan().toString()
    sinks.write_store(df, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 3


def test_documents(spark, tmp_path):
    counters = spark.createDataFrame([(5, 3)], "records_total long, records_kept long")
    laws = spark.createDataFrame([("A", 2), ("B", 1)], "law_code string, n long")
    out = sinks.report(counters, records_by_law=(laws, "law_code"))
    sinks.write_json(out, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"records_total": 5, "records_kept": 3, "records_by_law": {"A": 2, "B": 1}}
    flags = ", ".join(f"{f} boolean" for f in judging.FLAGS)
    judged = spark.createDataFrame([(True, True, False, True, None), (False, True, False, False, None), (None, None, None, None, "x")], f"{flags}, error string")
    assert sinks.judge_document(judging.judge_summary(judged), "m") == {"judge_model": "m", "total": 3, "judged": 2, "failed": 1, "legal_correct_rate": 0.5, "citation_correct_rate": 1.0, "hallucination_rate": 0.0, "passed_rate": 0.5}
    assert sinks.judge_document(judging.judge_summary(judged.filter("error = 'x'")), "m") == {"judge_model": "m", "total": 1, "judged": 0, "failed": 1}


def test_quality_and_its_document(spark):
    c = spark.createDataFrame([(1, k, 0.1 * k, 1.0 - 0.1 * k) for k in range(1, 5)], "query_id long, cand_pos int, score double, cross_score double")
    g = spark.createDataFrame([(1, 1, 0), (1, 4, 4)], "query_id long, cand_pos int, grade int")
    values, summary = answer.retrieval_quality(c, g, last_k=3)
    assert {r["k"]: r["ndcg"] for r in values.collect()} == {2: 0.0, 3: 0.0}
    better, _ = answer.retrieval_quality(c.withColumn("cross_score", -F.col("cross_score")), g, reranked=True, last_k=3)
    assert {r["k"]: r["ndcg"] for r in better.collect()} == {2: 1.0, 3: 1.0}
    assert sinks.ndcg_document(summary, embedding_model="e") == {"embedding_model": "e", "average_results": {"ndcg@2": {"mean": 0.0, "std": 0.0, "n": 1}, "ndcg@3": {"mean": 0.0, "std": 0.0, "n": 1}}}


def test_artefacts_and_names(spark, tmp_path):
    df = spark.createDataFrame([("Kaj je DDV?", 1), ("?!", 2)], "q string, x int").withColumn("slug", sinks.slug_column(F.col("q")))
    sinks.write_query_artifacts(df, "slug", str(tmp_path / "a"))
    assert sorted(p.name for p in (tmp_path / "a").glob("slug=*")) == ["slug=Kaj_je_DDV", "slug=query"]
    sinks.write_text(df, F.concat("q", F.lit("|")), str(tmp_path / "t"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["?!|", "Kaj je DDV?|"]
    names = spark.range(1).select(result_file_name(F.lit("BAAI/bge-m3")), result_file_name(F.lit("a/b"), F.lit("c-d"))).first()
    assert tuple(names) == ("BAAI_bge_m3__no_reranker.json", "a_b__reranker_c_d.json")


def test_a_fault_names_its_file_and_line_across_blocks(spark, tmp_path):
    """Two files, each read in many blocks; the fault stands far inside the second, after blank lines."""
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"id": k, "text": "x" * 200}) for k in range(3000)]
    (folder / "a.jsonl").write_text("\n".join(lines))
    (folder / "b.jsonl").write_text("\n".join([*lines[:1500], "", "", *lines[1500:2000], '{"id": 7, "text": ', *lines[2000:]]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "64k")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        with pytest.raises(Exception, match=r"b\.jsonl, line 2003: not JSON: \{.id.: 7"):
            readers.read_jsonl(spark, str(folder), "id long, text string", numbered=True).write.format("noop").mode("overwrite").save()
        assert readers.read_jsonl(spark, str(folder / "a.jsonl"), "id long, text string", position="at", numbered=True).orderBy("at").select("id").collect() == [(k,) for k in range(3000)]
        assert [(r["file"][-7:], r["line"]) for r in readers.faulty_lines(spark, str(folder), "id long, text string").collect()] == [("b.jsonl", 2003)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

