import brute

from quillspark.llm import exact_dedup as op


def test_matches_brute_force(spark, small):
    rows = [(r[0], r[1]) for r in small.select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in op.exact_dedup(small).collect())
    assert got == brute.dedup(rows)


def test_odd_rows(spark, odd):
    rows = op.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["keep_id"] == 3 and r["group_size"] == 3 for d in (1, 3) for r in by[d])  # most code points
    assert sorted(r["kept"] for r in by[3]) == [False, True] and not by[1][0]["kept"]  # of repeated rows one stays
    assert by[5][0]["keep_id"] == by[6][0]["keep_id"] == by[7][0]["keep_id"] == 7
    assert by[8][0]["kept"] and by[9][0]["keep_id"] == 8
    assert by[None][0]["kept"] and by[None][0]["keep_id"] is None
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_keeps_one_row_of_each(spark, odd, nothing):
    kept = op.keep_first_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == op.exact_dedup(odd).filter("kept").count()
    assert op.keep_first_copies(nothing).count() == 0 and op.exact_dedup(nothing).count() == 0


def test_many_runs(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(29)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in op.exact_dedup(df).collect())
    assert got == brute.dedup(rows)
