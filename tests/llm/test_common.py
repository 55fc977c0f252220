import pytest

from quillspark.llm import common


@pytest.mark.parametrize("most", [50_000, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_counted_join_equals_a_plain_join(spark, monkeypatch, most, how):
    """A hot key, keys of one row, keys without a partner, null keys and clashing names; broadcast and salted."""
    rows = [(i, 1 if i % 3 else 2 if i % 2 else i, "x" if i % 5 else None) for i in range(300)]
    rows = common.staged(spark.createDataFrame(rows, "uid long, k long, l string").repartition(5), "rows")
    table = rows.filter("k % 4 <> 0 and l is not null").groupBy("k", "l").count().withColumnRenamed("count", "__many")
    table = common.staged(table.withColumn("n", table["__many"]).drop("__many"), "table")
    plain = common.spread_join
    monkeypatch.setattr(common, "spread_join", lambda *args: plain(*args, most=most))
    got = common.counted_join(rows, table, ["k", "l"], "uid", "n", how, most=20)
    want = rows.join(table, ["k", "l"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_digest_of_a_third_of_the_rows_meets_no_single_task(spark):
    """Without AQE, no task of the last join holds the group of copies."""
    from quillspark.llm import exact_dedup

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(60_000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', concat('text ', id div 2)) text").repartition(8)
        got = exact_dedup.exact_dedup(df)
        per_task = [r["count"] for r in got.groupBy(common.F.spark_partition_id().alias("p")).count().collect()]
        assert got.count() == 60_000 and max(per_task) < 60_000 / 6
        assert got.filter("group_size = 20000").count() == 20_000 and got.filter("kept and group_size = 20000").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
