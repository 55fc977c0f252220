"""Incremental indexing of a folder of JSON lines (an extension: the batch job reads everything each time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunking, relevance
from quillspark.profiles import SLOVENIAN_LAW, Profile
from quillspark.schemas import RAW_RECORD


def index_stream(spark: SparkSession, source: str, store: str, checkpoint: str, profile: Profile = SLOVENIAN_LAW, max_chars: int = chunking.MAX_CHARS, keep_nonparsed: bool = False, **options):
    """A streaming query that chunks new files; each batch writes its own folder, so a repeated batch replaces itself.

    Positions carry the number of their batch in the upper bits, so they are unique over all folders.
    """
    records = spark.readStream.schema(RAW_RECORD).json(source)

    def take(batch: DataFrame, number: int) -> None:
        rows = relevance.normalize_records(batch).withColumn("record_pos", F.lit(number) * (1 << 48) + F.monotonically_increasing_id())
        rows = relevance.kept(relevance.with_reason(rows, profile, **options)).drop("reason", "error")
        chunking.chunks(rows, profile, max_chars, keep_nonparsed).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
