import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.plans import journal


def requests(spark, n=200):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("item"), F.concat(F.lit("question "), "id").alias("request")).repartition(5)


def logged(folder):
    """A client that notes each call in a file of its own, as tasks run in other processes."""
    os.makedirs(folder, exist_ok=True)

    def client(text):
        with open(f"{folder}/{os.getpid()}-{os.urandom(8).hex()}", "w") as f:
            f.write(text)
        return text.upper()

    return client


def calls(folder):
    out = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            out.append(f.read())
    return sorted(out)


def rows(df):
    return sorted((r["item"], r["reply"], r["call_error"]) for r in df.collect())


def test_a_killed_run_is_resumed_without_repeated_calls(spark, tmp_path):
    """The process of a task dies half-way, more than once, and so does the whole run; in the end all is as in an unbroken run."""
    note, path = str(tmp_path / "calls"), str(tmp_path / "journal")
    client, marks = logged(note), str(tmp_path / "marks")
    os.makedirs(marks)

    def dies(text):
        n = int(text.split()[1])
        if n % 50 == 17 and not os.path.exists(f"{marks}/{n}"):  # the first time, the worker is killed before it answers
            open(f"{marks}/{n}", "w").close()
            os.kill(os.getpid(), 9)
        return client(text)

    table = requests(spark)
    for _ in range(10):  # a local session does not repeat failed tasks, so the run itself is
        try:
            got, called = journal.ask_all(table, "item", "request", dies, path, buckets=4)
            break
        except Exception:
            assert len(calls(note)) < 200
    unbroken, all_called = journal.ask_all(table, "item", "request", str.upper, str(tmp_path / "whole"), buckets=4)
    assert all_called == 200 and rows(got) == rows(unbroken)
    assert calls(note) == sorted(f"question {k}" for k in range(200))  # none twice
    assert len(os.listdir(marks)) == 4 and called < 200
    again, called = journal.ask_all(table, "item", "request", dies, path, buckets=4)
    assert called == 0 and rows(again) == rows(unbroken)


def test_errors_stay_or_are_asked_again(spark, tmp_path):
    path = str(tmp_path / "j")

    def shaky(text):
        if text.endswith("3"):
            raise OSError("late")
        return text

    got, called = journal.ask_all(requests(spark, 20), "item", "request", shaky, path, buckets=3, at_once=4)
    assert called == 20 and sorted(r["item"] for r in got.filter("call_error = 'OSError: late' and reply is null").collect()) == ["k13", "k3"]
    assert journal.ask_all(requests(spark, 20), "item", "request", str.upper, path, buckets=3)[1] == 0
    mended, called = journal.ask_all(requests(spark, 20), "item", "request", str.upper, path, buckets=3, again=True)
    assert called == 2 and mended.filter("call_error is not null").count() == 0
    with pytest.raises(Exception, match="late"):
        journal.ask_all(requests(spark, 20), "item", "request", shaky, str(tmp_path / "f"), buckets=3, fail_fast=True)


def test_cut_lines_repeated_keys_and_nulls(spark, tmp_path):
    path = tmp_path / "j"
    table = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "y"), ("č\n\"", "z")], "item string, request string")
    got, called = journal.ask_all(table, "item", "request", lambda t: f"<{t}>", str(path), buckets=1)
    assert called == 3 and rows(got) == [("a", "<x>", None), ("b", "<None>", None), ("č\n\"", "<z>", None)]
    file = next(p for p in (path / "bucket=0").iterdir() if p.suffix == ".jsonl")
    text = file.read_text()
    last = next(x for x in text.splitlines() if json.loads(x)["key"] == "b")
    file.write_text("".join(x + "\n" for x in text.splitlines() if x != last) + last[: len(last) // 2])
    got, called = journal.ask_all(table, "item", "request", lambda t: f"<{t}>", str(path), buckets=1)
    assert called == 1 and len(rows(got)) == 3
    assert journal.ask_all(table.filter("item = 'none'"), "item", "request", str, str(tmp_path / "e"), buckets=2)[1] == 0


def test_files_are_turned_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "LINES_A_FILE", 7)
    run = journal._replies(str(tmp_path), str.upper, 1, 0.0, 1, False, False)
    from pyspark import TaskContext

    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Task))
    import pyarrow as pa

    list(run(iter([pa.RecordBatch.from_pydict({"key": [str(k) for k in range(20)], "text": ["t"] * 20})])))
    assert len(os.listdir(tmp_path / "bucket=0")) == 3
