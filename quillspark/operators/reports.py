"""Counters of an indexing run and statistics of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import collapse_whitespace, word_count

PREVIEW_CHARS = 350
#: Wording that marks doubt or a refusal, and wording that names a legal source. Ours: no list is published.
UNCERTAIN = ("ne morem", "ni mogoče", "ni dovolj", "ni jasno", "ni podatka", "ne vem", "nisem prepričan", "ni razvidno")
SOURCE_WORDS = ("člen", "zakon", "uredba", "pravilnik")


def record_counters(kept: DataFrame, observed: dict[str, int]) -> DataFrame:
    """One row of counts: those that were ``observed`` while the records were read, and what became of the ``kept`` ones (n_chunks, error)."""
    good = F.col("error").isNull()
    return kept.agg(
        *(F.lit(n).cast("long").alias(name) for name, n in observed.items()),
        F.count_if(good).alias("records_with_chunks"),
        F.count_if(F.col("n_chunks") == 0).alias("records_no_chunks"),
        F.count_if(~good).alias("records_faulty"),
        F.coalesce(F.sum(F.when(good, F.col("n_chunks"))), F.lit(0)).alias("chunks_total"),
    )


def counts(df: DataFrame, key: Column, name: str, missing: str = "UNKNOWN") -> DataFrame:
    return df.groupBy(F.coalesce(key, F.lit(missing)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def tag_counts(chunks: DataFrame, tags: str = "domain_tags") -> DataFrame:
    return chunks.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, key: Column, position: str, name: str, most: int = 30) -> DataFrame:
    """The most frequent keys; among equally frequent ones that seen first."""
    d = df.groupBy(F.coalesce(key, F.lit("UNKNOWN")).alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_seen"))
    return d.orderBy(F.desc("n"), "first_seen").limit(most)


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def answer_stats(answers: DataFrame, answer: str = "answer", n_sources: str = "n_sources", error: str = "error", uncertain: tuple[str, ...] = UNCERTAIN, source_words: tuple[str, ...] = SOURCE_WORDS) -> DataFrame:
    has = F.coalesce(F.col(answer), F.lit("")) != ""
    return answers.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has).alias("with_answer"),
        F.count_if(~has).alias("without_answer"),
        F.count_if(F.col(error).isNotNull()).alias("with_error"),
        F.count_if(mentions_any(F.col(answer), uncertain)).alias("uncertain"),
        F.count_if(mentions_any(F.col(answer), source_words)).alias("names_source"),
        F.avg(F.when(has, word_count(F.col(answer)))).alias("avg_words"),
        F.avg(n_sources).alias("avg_sources"),
    )


def prediction_table(predictions: DataFrame) -> DataFrame:
    """A row for each prediction: words, sources, top law and article, distinct gold laws, two flags, preview."""
    answer = F.col("prediction.answer")
    first = F.get("prediction.sources", 0)
    laws = F.array_distinct(F.filter(F.transform("gold_sources", lambda s: s["law_code"]), lambda x: x.isNotNull()))
    clean = collapse_whitespace(F.coalesce(answer, F.lit("")))
    return predictions.select(
        "id",
        word_count(F.coalesce(answer, F.lit(""))).alias("answer_words"),
        F.coalesce(F.size("prediction.sources"), F.lit(0)).alias("num_sources"),
        first["law_code"].alias("top_pred_law"),
        first["article_label"].alias("top_pred_article"),
        F.array_join(laws, ",").alias("gold_laws"),
        mentions_any(answer, UNCERTAIN).alias("has_uncertainty"),
        mentions_any(answer, SOURCE_WORDS).alias("has_source_reference"),
        F.when(F.length(clean) > PREVIEW_CHARS, F.concat(F.substring(clean, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(clean).alias("preview"),
    )


def most_common_laws(predictions: DataFrame, of: str = "predicted", most: int = 10) -> DataFrame:
    """law_code, n: the laws that stand first among the predicted sources, or all laws of the gold sources ("gold")."""
    if of == "gold":
        laws = predictions.select(F.explode("gold_sources").alias("s")).select("s.law_code")
    else:
        laws = predictions.select(F.get("prediction.sources", 0)["law_code"].alias("law_code"))
    return laws.filter("law_code is not null").groupBy("law_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "law_code").limit(most)


def comparison_text(predictions: DataFrame) -> Column:
    """Question, gold answer and model answer of a prediction as a text block."""
    shown = lambda c: collapse_whitespace(F.coalesce(c, F.lit("")))
    parts = ["=" * 100 + "\nID: ", F.coalesce("id", F.lit("")), "\nQUESTION:\n", shown(F.col("question")), "\n\nGOLD ANSWER:\n", shown(F.col("gold_answer")), "\n\nMODEL ANSWER:\n", shown(F.col("prediction.answer")), "\n\n"]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
