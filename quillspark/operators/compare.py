"""Comparison of NDCG result files of several configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """file, embedding_model, reranking_enabled, reranking_model, k, mean, std of each value of each JSON file.

    A value is an object with mean and std, a bare number, or null (left out). A folder without files raises.
    """
    schema = "embedding_model STRING, reranking_enabled BOOLEAN, reranking_model STRING, average_results MAP<STRING, STRING>"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    files = files.withColumn("file", F.col("_metadata.file_name"))
    if files.isEmpty():
        raise ValueError(f"no JSON files in {folder}")
    each = files.select("file", "embedding_model", "reranking_enabled", "reranking_model", F.explode("average_results").alias("name", "value"))
    parsed = F.from_json("value", "mean DOUBLE, std DOUBLE")
    mean = F.coalesce(parsed["mean"], F.expr("try_cast(value AS DOUBLE)"))
    out = each.select("file", "embedding_model", "reranking_enabled", "reranking_model", F.replace("name", F.lit("ndcg@"), F.lit("")).cast("int").alias("k"), mean.alias("mean"), parsed["std"].alias("std"))
    return out.filter("mean is not null")


def with_label(results: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Adds label: display names of the embedding model and, where one was used, the reranker."""
    known = F.create_map(*(F.lit(x) for kv in (names or {"": ""}).items() for x in kv))
    shown = lambda c: F.coalesce(known[F.col(c)], F.col(c))
    embedding = F.coalesce(shown("embedding_model"), F.lit("unknown_model"))
    reranked = F.coalesce("reranking_enabled", F.lit(False)) & (F.coalesce(shown("reranking_model"), F.lit("")) != "")
    return results.withColumn("label", F.when(reranked, F.concat(embedding, F.lit(" + "), shown("reranking_model"))).otherwise(embedding))


def compare(results: DataFrame) -> DataFrame:
    """file, label, mean_ndcg, n_k, has_std of each configuration, best first."""
    out = results.groupBy("file", "label").agg(F.avg("mean").alias("mean_ndcg"), F.count(F.lit(1)).alias("n_k"), F.bool_or(F.col("std").isNotNull()).alias("has_std"))
    return out.orderBy(F.desc("mean_ndcg"), "file")


def std_curves(results: DataFrame) -> DataFrame:
    """label, k, std where a configuration has any std; a missing one is 0."""
    some = results.groupBy("file").agg(F.bool_or(F.col("std").isNotNull()).alias("has_std")).filter("has_std")
    return results.join(some, "file").select("file", "label", "k", F.coalesce("std", F.lit(0.0)).alias("std"))
