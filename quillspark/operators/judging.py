"""Answers judged by a model: payload, tolerant parsing of the reply, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import coerce_bool, strip

FLAGS = ("legal_correct", "citation_correct", "hallucination", "passed")
COMPACT = ("law_title", "law_code", "article_label", "paragraph_number", "text")
INSTRUCTION = "Evaluate this chatbot answer. Return only JSON matching the schema.\n\n"  # fixed value


def compact_sources(sources: Column) -> Column:
    """Five fields of each source; a null array is empty."""
    return F.coalesce(F.transform(sources, lambda s: F.struct(*(s[c].alias(c) for c in COMPACT))), F.array())


def judge_input(items: DataFrame) -> Column:
    """The user message for the judge, from columns id, question, gold_answer, gold_sources and prediction."""
    body = F.struct(
        "id",
        "question",
        "gold_answer",
        compact_sources(F.col("gold_sources")).alias("gold_sources"),
        F.col("prediction.answer").alias("model_answer"),
        compact_sources(F.col("prediction.sources")).alias("model_sources"),
        F.col("prediction.error").alias("prediction_error"),
    )
    return F.concat(F.lit(INSTRUCTION), F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"}))


def parse_reply(reply: Column) -> Column:
    """struct<legal_correct, citation_correct, hallucination, passed, rationale, error>.

    The whole reply is read as JSON, else what stands between its first "{" and last "}". The error says
    that there is no JSON or names the first field that is missing; then the rest is null.
    """
    whole = F.try_parse_json(strip(reply))
    inner = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    v = F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole).otherwise(inner)
    text = F.to_json(v)
    have = F.json_object_keys(text)
    missing = F.coalesce(*(F.when(~F.array_contains(have, f), F.lit(f)) for f in FLAGS))
    error = F.when(have.isNull(), F.lit("no JSON object")).when(missing.isNotNull(), F.concat(F.lit("missing "), missing))
    field = lambda f: F.get_json_object(text, f"$.{f}")
    # A list or an object is true unless empty.
    truth = lambda f: F.when(field(f).rlike(r"\A[\[{]"), ~field(f).isin("[]", "{}")).otherwise(coerce_bool(field(f)))
    return F.struct(
        *(F.when(error.isNull(), truth(f)).alias(f) for f in FLAGS),
        F.when(error.isNull(), strip(F.coalesce(field("rationale"), F.lit("")))).alias("rationale"),
        error.alias("error"),
    )


def judge_summary(judged: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """total, judged, failed and the rate of each flag over rows without error; no rates (null) if all failed."""
    good = F.col("error").isNull()
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("judged"),
        F.count_if(~good).alias("failed"),
        *(F.avg(F.when(good, F.coalesce(F.col(f), F.lit(False)).cast("double"))).alias(f"{f}_rate") for f in flags),
    )
