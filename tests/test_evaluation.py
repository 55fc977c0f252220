import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import compare, judging, reports, tagging
from quillspark.plans import evaluate
from quillspark.profiles import SLOVENIAN_LAW
from quillspark.schemas import PREDICTION
from quillspark.sources import readers, sinks


def predictions(spark):
    source = {c: "t" for c in ("law_title", "law_code", "article_label", "paragraph_number", "text")}
    rows = [
        {"id": "a", "question": "q?", "gold_answer": "g", "gold_sources": [source | {"law_code": "ZDDD"}, source | {"law_code": "ZDDD"}], "prediction": {"answer": "Po 3. členu  ne morem.\n", "sources": [{"rank": 1, "law_code": "ZDO", "article_label": "1. člen"}], "model": "m", "error": None}},
        {"id": "b", "question": "q2", "gold_answer": "g", "gold_sources": None, "prediction": {"answer": None, "sources": [], "model": "m", "error": "x"}},
        {"id": "c", "question": "q3", "gold_answer": "g", "gold_sources": [], "prediction": {"answer": "da", "sources": [], "model": "m", "error": None}},
    ]
    return spark.read.schema(PREDICTION).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_replies_are_read_tolerantly(spark):
    good = '{"legal_correct": true, "citation_correct": "Yes", "hallucination": 0, "passed": 1, "rationale": " r "}'
    rows = [good, f"Sure: {good} bye", '{"legal_correct": true}', "none", "", None, '{"legal_correct": "no", "citation_correct": [], "hallucination": {"a": 1}, "passed": null, "rationale": 5}', "{bad} {"]
    p = [r["p"] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(judging.parse_reply(F.col("r")).alias("p")).collect()]
    assert p[0] == p[1] and (p[0]["legal_correct"], p[0]["citation_correct"], p[0]["hallucination"], p[0]["passed"], p[0]["rationale"], p[0]["error"]) == (True, True, False, True, "r", None)
    assert p[2]["error"] == "missing citation_correct" and p[2]["legal_correct"] is None
    assert all(p[k]["error"] == "no JSON object" for k in (3, 4, 5, 7))
    assert (p[6]["legal_correct"], p[6]["citation_correct"], p[6]["hallucination"], p[6]["passed"], p[6]["rationale"]) == (False, False, True, False, "5")


def test_judging(spark):
    def client(request):
        payload = json.loads(request[len(judging.INSTRUCTION) :])
        if payload["id"] == "b":
            raise RuntimeError("down")
        assert set(payload) == {"id", "question", "gold_answer", "gold_sources", "model_answer", "model_sources", "prediction_error"}
        return json.dumps({"legal_correct": payload["id"] == "a", "citation_correct": False, "hallucination": False, "passed": True})

    judged = evaluate.judge(predictions(spark), client, "stub").cache()
    rows = {r["id"]: r for r in judged.collect()}
    assert rows["b"]["judgment"] is None and rows["b"]["error"] == "RuntimeError: down"
    r = evaluate.judge_rates(judged).first()
    assert (r["total"], r["judged"], r["failed"], r["legal_correct_rate"], r["passed_rate"]) == (3, 2, 1, 0.5, 1.0)
    none = evaluate.judge_rates(judged.filter("id = 'b'")).first()
    assert none["judged"] == 0 and none["passed_rate"] is None
    with pytest.raises(Exception, match="down"):
        evaluate.judge(predictions(spark), client, "stub", fail_fast=True).collect()


def test_prediction_table_and_text(spark):
    p = predictions(spark)
    r = {x["id"]: x for x in reports.prediction_table(p).collect()}
    assert (r["a"]["answer_words"], r["a"]["top_pred_law"], r["a"]["gold_laws"], r["a"]["has_uncertainty"], r["a"]["has_source_reference"], r["a"]["preview"]) == (5, "ZDO", "ZDDD", True, True, "Po 3. členu ne morem.")
    assert (r["b"]["answer_words"], r["b"]["num_sources"], r["b"]["top_pred_law"]) == (0, 0, None)
    t = p.filter("id = 'a'").select(reports.comparison_text(p)).first()[0]
    assert t == "=" * 100 + "\nID: a\nQUESTION:\nq?\n\nGOLD ANSWER:\ng\n\nMODEL ANSWER:\nPo 3. členu ne morem.\n\n"


def test_comparison_of_result_files(spark, tmp_path):
    docs = {"a": {"embedding_model": "e/1", "reranking_enabled": True, "reranking_model": "r", "average_results": {"ndcg@2": {"mean": 0.5, "std": 0.1, "n": 3}, "ndcg@3": None}}, "b": {"embedding_model": "e/1", "reranking_enabled": False, "reranking_model": None, "average_results": {"ndcg@2": 0.75, "ndcg@3": {"mean": None, "std": None, "n": 0}, "ndcg@4": {"mean": 0.25, "std": None, "n": 1}}}}
    for n, x in docs.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "c.txt").write_text("no")
    d = compare.with_label(compare.read_results(spark, str(tmp_path)), {"e/1": "E"})
    rows = [(r["label"], r["mean_ndcg"], r["n_k"], r["has_std"]) for r in compare.compare(d).collect()]
    assert rows == [("E + r", 0.5, 1, True), ("E", 0.5, 2, False)]
    assert [(r["k"], r["std"]) for r in compare.std_curves(d).collect()] == [(2, 0.1)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        compare.read_results(spark, str(tmp_path / "empty"))


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "naziv": "č", "more": 2}\n\n{"id": 2}\n', encoding="utf-8")
    from quillspark.schemas import RAW_RECORD

    rows = readers.read_jsonl(spark, str(p), RAW_RECORD, position="pos").orderBy("pos").collect()
    assert [(r["id"], r["naziv"]) for r in rows] == [(1, "č"), (2, None)]
    for bad, blank in (('{"id": 1}\n{"id": \n', "skip"), ('{"id": 1}\n\n', "fail")):
        p.write_text(bad)
        with pytest.raises(Exception, match="not JSON"):
            readers.read_jsonl(spark, str(p), RAW_RECORD, blank_lines=blank).collect()
    sinks.write_jsonl(spark.createDataFrame([(1, None, "č")], "a int, b string, c string"), str(tmp_path / "out"))
    assert "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("part-*")) == '{"a":1,"b":null,"c":"č"}\n'


def test_dense_positions(spark):
    d = readers.with_positions(spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "x int").repartition(3), "x", "pos")
    assert sorted((r["x"], r["pos"]) for r in d.collect()) == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]


def test_other_readers(spark, tmp_path, monkeypatch):
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert [(r["chunk_pos"], r["embedding"]) for r in readers.read_matrix(spark, str(tmp_path / "m.npy"), rows=3).orderBy("chunk_pos").collect()] == [(k, [3.0 * k, 3.0 * k + 1, 3.0 * k + 2]) for k in range(4)]
    (tmp_path / "q.txt").write_text(" a \n\n \nb")
    assert sorted(r["query"] for r in readers.read_lines(spark, str(tmp_path / "q.txt")).collect()) == ["a", "b"]
    (tmp_path / "s.yaml").write_text("top_k_chunks: 7\n")
    assert readers.load_settings(str(tmp_path / "s.yaml")).top_k_chunks == 7
    (tmp_path / "s.yaml").write_text("other: 7\n")
    with pytest.raises(TypeError):
        readers.load_settings(str(tmp_path / "s.yaml"))
    (tmp_path / "p.yaml").write_text("text: ' hi '\n")
    assert readers.load_prompt(str(tmp_path / "p.yaml")) == "hi"
    (tmp_path / "p.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        readers.load_prompt(str(tmp_path / "p.yaml"))
    monkeypatch.setenv("QS_OLD", "kept")
    monkeypatch.delenv("QS_NEW", raising=False)
    (tmp_path / ".env").write_text("# c\nexport QS_NEW='a=b'\nQS_OLD=x\nbroken\n")
    assert readers.load_env(str(tmp_path / ".env")) == {"QS_NEW": "a=b"}
    assert readers.chat_url("http://h/v1/") == readers.chat_url("http://h") == "http://h/v1/chat/completions" and readers.api_base("http://h/v1/chat/completions") == "http://h/v1"
    monkeypatch.setenv("QS_URL", "http://e")
    names = {"base_url": "QS_URL", "model": "QS_NO_MODEL"}
    (tmp_path / "boot.yaml").write_text("base_url: http://b\nmodel_path: m\n")
    boot = str(tmp_path / "boot.yaml")
    assert readers.model_endpoint("http://g", "x") == ("http://g", "x")
    assert readers.model_endpoint(None, None, boot, names) == ("http://e", "m") and readers.model_endpoint(boot_file=boot) == ("http://b", "m")
    with pytest.raises(FileNotFoundError):
        readers.model_endpoint("http://g", boot_file=str(tmp_path / "none.yaml"))
    (tmp_path / "s.yaml").write_text("reranking_model: r\nllm_top_p: 0.5\nrag_data_path: /x\n")
    s = readers.load_settings(str(tmp_path / "s.yaml"))
    assert (s.reranking_model, s.top_k_chunks, s.model, s.places) == ("r", 100, {"top_p": 0.5}, {"rag_data_path": "/x"})
    with pytest.raises(FileNotFoundError, match="b: "):
        readers.missing_paths({"a": str(tmp_path), "b": "/nowhere"})
    assert sinks.index_metric("cosine") == "ip"
    with pytest.raises(ValueError):
        sinks.index_metric("dot")


def test_text_functions(spark):
    rows = ["Zakon (ZDoh-2) ", "Zakon (a) x", None, "  (b)  ", " x ", "Ž (123456789012345678901234567890123)"]
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select(T.law_code(F.col("t")), T.strip(F.col("t")), T.slug(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["ZDoh-2", None, None, None, None, None] and [g[1] for g in got] == [None if r is None else r.strip() for r in rows]
    assert got[0][2] == "Zakon_ZDoh-2"
    assert [r[0] for r in spark.createDataFrame([("true",), (" YES",), ("0",), ("2",), ("no",), (None,), ("",)], "t string").select(T.coerce_bool(F.col("t"))).collect()] == [True, True, False, True, False, False, False]
    assert spark.range(1).select(T.query_text(F.lit(" passage:x" + "y" * 900))).first()[0] == "x" + "y" * 799
    assert spark.range(1).select(T.keyword_hits(F.lit("ČLEN davek davek"), ["člen", "DAVEK", "ddv"])).first()[0] == 2
    tags = spark.range(1).select(tagging.domain_tags(F.lit("ZGD-1"), F.lit("T"), F.lit("Vsak preROKuje"), SLOVENIAN_LAW)).first()[0]
    assert tags == ["procedure"]


def test_streaming_index(spark, tmp_path):
    from quillspark.streaming.incremental import index_stream

    (tmp_path / "in").mkdir()
    row = {"id": 1, "naziv": "Z (ZDDV-1)", "mopedId": "M", "text": "1. člen\nx"}
    (tmp_path / "in/a.json").write_text(json.dumps(row) + "\n")
    run = lambda: index_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    assert run()
    (tmp_path / "in/b.json").write_text(json.dumps(row | {"id": 2}) + "\n")
    assert run() and sorted(r["record_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2]


def test_faulty_lines_are_numbered_and_missing_keys_differ_from_null(spark, tmp_path):
    from quillspark.schemas import RAW_RECORD

    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnope\n{"id": 2, "naziv": null}\n{"id": \n')
    bad = readers.faulty_lines(spark, str(tmp_path / "a.jsonl"), RAW_RECORD).orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in bad] == [(3, "nope"), (5, '{"id": ')] and bad[0]["file"].endswith("a.jsonl")
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": 2, "naziv": null}\n{"id": 3, "naziv": "x"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), RAW_RECORD, missing={"naziv": ""}).orderBy("id").collect()
    assert [r["naziv"] for r in rows] == ["", None, "x"]


def test_predictions_keep_every_item(spark):
    from quillspark.plans import evaluate

    gold = spark.createDataFrame([(k, f"q{k}", f"Q{k}", "g", [("L", "C")]) for k in range(4)], "item_pos int, id string, question string, gold_answer string, gold_sources array<struct<law_title: string, law_code: string>>")
    answered = spark.createDataFrame([("q0", "a", [(1,)], None), ("q1", "lost", [(2,)], "Timeout: x")], "id string, answer string, sources array<struct<rank: int>>, error string")
    rows = [(r["id"], r["prediction"]["answer"], len(r["prediction"]["sources"]), r["prediction"]["error"]) for r in evaluate.predictions(gold, answered, "m", limit=3).orderBy("id").collect()]
    assert rows == [("q0", "a", 1, None), ("q1", None, 0, "Timeout: x"), ("q2", None, 0, "no answer")]


def test_grading_tries_again_and_gives_zeros(spark, tmp_path):
    from quillspark.operators import ndcg
    from quillspark.plans import evaluate

    log = str(tmp_path / "calls")

    def client(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        with open(log) as f:
            again = f.read().count(prompt + "\n")
        if prompt == "down" or prompt == "late" and again < 3:
            raise TimeoutError
        return "no JSON" if prompt == "odd" and again < 2 else '{"scores": [4, 3]}'

    prompts = spark.createDataFrame([(1, 0, "good"), (1, 1, "late"), (2, 0, "odd"), (2, 1, "down")], "query_id long, batch int, prompt string").coalesce(1)
    grades = evaluate.graded(prompts, client, size=3, wait=0.01, at_once=2)
    candidates = spark.createDataFrame([(q, k) for q in (1, 2) for k in range(1, 7)], "query_id long, cand_pos int")
    got = {(r["query_id"], r["cand_pos"]): r["grade"] for r in ndcg.with_grades(candidates, grades).collect()}
    assert [got[1, k] for k in range(1, 7)] == [4, 3, 0, 4, 3, 0] and [got[2, k] for k in range(1, 7)] == [4, 3, 0, 0, 0, 0]


def test_an_index_without_chunks_is_an_error(spark):
    from quillspark.plans import index

    none = spark.createDataFrame([], "record_pos long, id long, naziv string, mopedId string, eva string, epa string, sop string, text string")
    with pytest.raises(ValueError, match="no chunks"):
        index.require_chunks(index.build_index(none))
