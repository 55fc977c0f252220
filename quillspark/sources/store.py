"""Tables that are computed once: written into the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a session on one machine that has none makes its own, a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("quillspark.own.store.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.own.store.dir", own)
    return own


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """A scan of what ``df`` holds now: its rows outlive lost executors, and nothing is computed again. Gone when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
