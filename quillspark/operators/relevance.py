"""Record normalisation and the relevance filter with a recorded reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import keyword_hits, law_code
from quillspark.profiles import Profile

KEPT_REASONS = ("whitelist", "title_keyword", "text_keywords", "all_laws")
DROPPED_REASONS = ("not_in_whitelist", "irrelevant")
#: Parameters of the three ready-made strategies.
STRATEGIES = {"normal": {}, "whitelist": {"strict_whitelist": True}, "all-laws": {"all_laws": True, "keep_nonparsed": True}}


def normalize_records(raw: DataFrame) -> DataFrame:
    """The seven record fields; a null text is empty."""
    return raw.withColumn("text", F.coalesce("text", F.lit("")))


def relevance_reason(title: Column, text: Column, profile: Profile, strict_whitelist: bool = False, min_keyword_matches: int = 2, all_laws: bool = False) -> Column:
    """Why a record is kept or not; the cheap tests come first; the text of a record that its code decides is not searched."""
    if all_laws:
        return F.lit("all_laws")
    code = law_code(F.coalesce(title, F.lit("")))
    reason = F.when(code.isin(*profile.law_codes), "whitelist")
    if strict_whitelist:
        return reason.otherwise("not_in_whitelist")
    titled = keyword_hits(title, list(profile.title_keywords)) >= 1
    open_ = ~F.coalesce(code.isin(*profile.law_codes), F.lit(False))  # other texts are not searched
    hits = keyword_hits(F.when(open_, text), list(profile.text_keywords))
    return reason.when(titled, "title_keyword").when(hits >= min_keyword_matches, "text_keywords").otherwise("irrelevant")


def with_reason(records: DataFrame, profile: Profile, title: str = "naziv", text: str = "text", **options) -> DataFrame:
    """``records`` with reason and, for a null title that the filter cannot read, an error instead."""
    strict, everything = options.get("strict_whitelist", False), options.get("all_laws", False)
    unreadable = F.col(title).isNull() & F.lit(not strict and not everything)
    return records.withColumn("reason", F.when(~unreadable, relevance_reason(F.col(title), F.col(text), profile, **options))).withColumn(
        "error", F.when(unreadable, "title is null")
    )


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isin(*KEPT_REASONS))
