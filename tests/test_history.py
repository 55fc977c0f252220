import pytest

from quillspark.operators import prompts
from quillspark.streaming import history


@pytest.fixture
def with_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", history.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, source, store, checkpoint):
    """Take what is new in the folder; the query ends, so the next call starts another from the checkpoint."""
    turns = spark.readStream.schema(history.TURN).option("maxFilesPerTrigger", 1).parquet(source)
    query = history.history_stream(turns).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.schema(history.KEPT).parquet(store)


def test_replay_in_batches_with_a_restart_equals_the_batch(with_store, sf, tmp_path):
    spark = with_store
    source, store, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id", "cast(turn as int) turn", "role", "text", "cast(null as string) error")
    for k, part in enumerate(("turn < 2", "turn = 2", "turn > 2")):
        turns.filter(part).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # two files meet one query, the third another
            run(spark, source, store, mark)
    want = {r["conv_id"]: [tuple(m) for m in r["history"]] for r in prompts.history_of(turns).collect()}
    got = {r["conv_id"]: [tuple(m) for m in r["history"]] for r in history.histories(spark.read.parquet(store)).collect()}
    assert got == want and len(got) > 10


def test_errors_empty_answers_and_repeats(with_store, tmp_path):
    spark = with_store
    source, store, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batches = [
        [(1, 1, "assistant", "a0", None), (1, 0, "user", "q0", None), (2, 0, "user", "q", "HTTP 500"), (2, 1, "assistant", "half", "HTTP 500"), (None, 0, "user", "x", None)],
        [(1, 2, "user", "q1", None), (1, 3, "assistant", "", None), (1, 0, "user", "q0", None), (2, 2, "user", "again", None)],
        [(1, 4, "user", None, None), (1, 5, "assistant", None, None), (3, 0, "system", "s", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, history.TURN).coalesce(1).write.mode("append").parquet(source)
        kept = run(spark, source, store, mark)
    got = {r["conv_id"]: [tuple(m) for m in r["history"]] for r in history.histories(kept).collect()}
    assert got == {1: [("user", "q0"), ("assistant", "a0"), ("user", "q1"), ("user", None)], 2: [("user", "again")], 3: [("system", "s")]}
