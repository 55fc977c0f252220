"""NDCG@k of graded candidates, for all k at once, and its statistics over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADING_BATCH = 25


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1


def grading_batches(candidates: DataFrame, size: int = GRADING_BATCH) -> DataFrame:
    """Adds batch (from 0) and place in the batch (from 1) by cand_pos, which counts from 1."""
    return candidates.withColumn("batch", F.floor((F.col("cand_pos") - 1) / size)).withColumn("batch_pos", (F.col("cand_pos") - 1) % size + 1)


def with_grades(candidates: DataFrame, grades: DataFrame) -> DataFrame:
    """Grades by query_id and cand_pos; a missing grade is 0."""
    return candidates.join(grades, ["query_id", "cand_pos"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ndcg(graded: DataFrame, predicted: str = "predicted", grade: str = "grade", first_k: int = 2, last_k: int = 50) -> DataFrame:
    """query_id, k, ndcg for each query and k.

    Candidates with equal predicted score share their mean gain; the ideal order is by gain; where no
    candidate has gain the value is 0, and a query with a single candidate has none (null).
    """
    d = graded.select("query_id", F.col(predicted).alias("_p"), gain(F.col(grade)).alias("_g"))
    by = W.partitionBy("query_id")
    d = d.withColumn("_shared", F.avg("_g").over(W.partitionBy("query_id", "_p"))).withColumn("_n", F.count(F.lit(1)).over(by))
    d = d.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_p")))).withColumn("_best", F.row_number().over(by.orderBy(F.desc("_g"))))
    discount = lambda r: F.lit(1.0) / F.log2(F.col(r) + 1)
    each = d.select("query_id", "_n", F.explode(F.array(F.struct(F.col("_rank").alias("k"), (F.col("_shared") * discount("_rank")).alias("dcg"), F.lit(0.0).alias("ideal")), F.struct(F.col("_best").alias("k"), F.lit(0.0).alias("dcg"), (F.col("_g") * discount("_best")).alias("ideal")))).alias("x"))
    sums = each.groupBy("query_id", "_n", F.col("x.k").alias("k")).agg(F.sum("x.dcg").alias("dcg"), F.sum("x.ideal").alias("ideal"))
    run = by.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.select("query_id", "_n", "k", F.sum("dcg").over(run).alias("dcg"), F.sum("ideal").over(run).alias("ideal"), F.lead("k").over(by.orderBy("k")).alias("next"))
    # Past its last candidate a query keeps its value.
    wide = sums.withColumn("k", F.explode(F.sequence("k", F.when(F.col("next").isNull(), F.greatest("k", F.lit(last_k))).otherwise(F.col("k")))))
    value = F.when(F.col("_n") == 1, F.lit(None)).when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0))
    return wide.filter(F.col("k").between(first_k, last_k)).select("query_id", F.col("k").cast("int").alias("k"), value.cast("double").alias("ndcg"))


def ndcg_summary(values: DataFrame) -> DataFrame:
    """k, mean, std (of the population), n over the values that are there."""
    return values.groupBy("k").agg(F.avg("ndcg").alias("mean"), F.stddev_pop("ndcg").alias("std"), F.count("ndcg").alias("n"))


def parse_scores(reply):
    """The list of whole numbers under "scores" in a grader's reply, null if there is none."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(body, "scores ARRAY<INT>")["scores"]


def batch_grades(replies: DataFrame, size: int = GRADING_BATCH) -> DataFrame:
    """query_id, cand_pos, grade from rows with query_id, batch (from 0) and scores: batches put together by position.

    Scores beyond the batch size are cut off; those a batch does not give (all, if it failed) are missing, and
    ``with_grades`` makes them 0.
    """
    each = replies.select("query_id", "batch", F.posexplode("scores").alias("i", "grade")).filter(F.col("i") < size)
    return each.select("query_id", (F.col("batch") * size + F.col("i") + 1).cast("int").alias("cand_pos"), F.coalesce("grade", F.lit(0)).alias("grade"))
