"""Segmentation of acts: leading noise, chapters, articles and the chapter that governs each article."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scan
from quillspark.functions.text import lines, normalize_whitespace, strip
from quillspark.profiles import Profile


def with_clean_text(df: DataFrame, text: str, profile: Profile, name: str) -> DataFrame:
    """Adds the text of stripped lines; before the first article line, empty and noise lines are left out."""
    return df.withColumn(name, scan.clean_lines(F.coalesce(text, F.lit("")), profile.article_lines, profile.noise_prefixes))


def sections(text: Column, profile: Profile) -> Column:
    """The articles that the headings of a profile give, in one scan: see ``scan.sections``."""
    lines = re.MULTILINE | re.IGNORECASE
    usual, other = (tuple((p, lines) for p in own) for own in (profile.articles, profile.roman_articles))
    return scan.sections(text, usual, other, tuple((p, 0) for p in profile.chapters))


def is_structural(line: Column, profile: Profile) -> Column:
    """Whether a line is nothing but a chapter heading or a numbered one."""
    out = F.lit(False)
    for p in (*profile.chapters, profile.numbered_heading):
        if p:
            out = out | line.rlike(rf"(?Uud)\A(?:{p})\z")
    return out


def articles(df: DataFrame, text: str, profile: Profile, keep_bare: bool = False, with_whole: bool = False) -> DataFrame:
    """A row for each article of the column ``text``: article_idx, article_start, article_number, article_label,
    article_heading, article_body, chapter, beside all columns of ``df``.

    Text before the first article is left out; a first line in parentheses is the heading; structural headings in the
    body are dropped; the forward style keeps its first line if that has more than two words. Rows without articles
    (or with a null text) give none, or with ``keep_bare`` one that has no article_idx but the text as whole_text, in place of ``text``. ``with_whole`` puts before the others
    a row of article_idx -1 that stands for the row of ``df`` itself.
    """
    d = df.withColumn("_articles", sections(F.col(text), profile))
    # The outer form, as the plain one would repeat the whole expression in a filter on its size at the scan.
    none = F.lit(None).cast(scan.SECTION)
    item = lambda k, a, whole: F.struct(k.cast("int").alias("article_idx"), a.alias("_a"), whole.cast("string").alias("whole_text"))
    null = F.lit(None)
    each = F.transform("_articles", lambda a, i: item(i, a, null))
    if keep_bare:
        each = F.when(F.size("_articles") > 0, each).otherwise(F.array(item(null, none, F.col(text))))
    if with_whole:
        each = F.concat(F.array(item(F.lit(-1), none, null)), each)
    columns = [c for c in df.columns if c != text or not keep_bare]  # else each article would carry the whole text
    d = d.select(*columns, F.explode_outer(each).alias("_x")).select(*columns, "_x.*")
    d = d if keep_bare else d.filter("_a is not null" if not with_whole else "_a is not null or article_idx = -1")
    d = d.withColumn("_lines", F.filter(F.transform(lines(F.col("_a.shown")), strip), lambda x: x != ""))
    heading = lambda x: x.rlike(r"\A\(.+\)\z")
    lead = F.get("_lines", F.lit(0))
    # A lambda that refers to a column made here would make it anew for each line, so it looks at its own line alone.
    body = F.filter("_lines", lambda x, i: ~((i == 0) & heading(x)) & ~is_structural(x, profile))
    number = F.col("_a.number")
    return d.select(
        *columns,
        *(["whole_text"] if keep_bare else []),
        "article_idx",
        F.col("_a.start").alias("article_start"),
        number.alias("article_number"),
        F.when(F.col("_a.forward"), F.concat(F.lit("Člen "), number)).otherwise(F.concat(number, F.lit(". člen"))).alias("article_label"),
        F.when(heading(lead), strip(F.expr("substring(_lines[0], 2, length(_lines[0]) - 2)"))).alias("article_heading"),
        normalize_whitespace(F.array_join(body, "\n")).alias("article_body"),
        F.col("_a.chapter").alias("chapter"),
    )


def asof_heading(rows: DataFrame, group: str, position: str, label: str, out: str) -> DataFrame:
    """The last non-null label at or before each row of its group: the line-table form of the chapter lookup."""
    frame = W.partitionBy(group).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(out, F.last(label, ignorenulls=True).over(frame))
