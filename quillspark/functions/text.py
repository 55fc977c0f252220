"""Text expressions with the white-space and case rules of Unicode, evaluated inside the JVM but for the search of keywords.

Patterns carry the flags ``U`` (Unicode classes), ``u`` with ``i`` (Unicode case) and ``d`` (only line feeds
end a line), so that they read the same text as the usual scripting-language engines do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import needles

#: What ends a line besides a line feed or carriage return (fixed values).
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


#: White space of Unicode, with the four separators that scripting languages count too (fixed values).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (``trim`` alone takes blanks only)."""
    return F.btrim(c, F.lit(WHITE))


def normalize_whitespace(c: Column) -> Column:
    """Line ends as line feeds, runs of blanks, tabs and no-break spaces as one blank, at most one empty line."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[\u00a0\t][\u00a0 \t]*| [\u00a0 \t]+", " ")  # a single blank, the usual case, is no match
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def collapse_whitespace(c: Column) -> Column:
    """Words joined by single blanks."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def lines(c: Column) -> Column:
    """Array of lines; the end of the text does not start another."""
    plain = F.when(c.rlike(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), F.regexp_replace(c, LINE_ENDS, "\n")).otherwise(c)  # few texts have other ends than line feeds
    split = F.split(plain, "\n", -1)
    held = F.when(plain.endswith("\n"), F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(held)


def word_count(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0)))


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """How many distinct keywords occur, without regard to case; occurrences are not counted."""
    return F.when(c.isNotNull(), F.size(needles.found(c, tuple(keywords))))


def law_code(title: Column) -> Column:
    """What stands in parentheses at the end of a title, null if nothing does."""
    return F.nullif(strip(F.regexp_extract(strip(title), r"\(([^()]{2,30})\)(?U:\s*)\z", 1)), F.lit(""))


def spans(c: Column, pattern: str) -> Column:
    """All matches in order as array<struct<start, stop, match>>, in code points from 0.

    There is no built-in that returns offsets: the gaps of a split and the matches alternate, so the running
    sum of their lengths gives each start.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(c, pattern, -1), F.lit(1), F.size(found))
    # Arrays are zipped first: what a lambda refers to from outside would be evaluated for every element.
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["match"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def slug(c: Column, most: int = 60) -> Column:
    c = F.regexp_replace(F.substring(c, 1, most), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", "_"), r"\A_+|_+\z", "")


def result_file_name(embedding_model: Column, reranking_model: Column | None = None) -> Column:
    plain = lambda c: F.translate(c, "/-", "__")
    rest = F.lit("no_reranker") if reranking_model is None else F.concat(F.lit("reranker_"), plain(reranking_model))
    return F.concat(plain(embedding_model), F.lit("__"), rest, F.lit(".json"))


def query_text(c: Column) -> Column:
    """A question as the online path embeds it: stripped, without the passage mark, 800 characters at most."""
    return F.substring(F.replace(strip(F.coalesce(c.cast("string"), F.lit(""))), F.lit("passage:"), F.lit("")), 1, 800)


def embedding_text(formatted: Column, prefix: str = "passage: ") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(formatted, F.lit("")))


def coerce_bool(c: Column) -> Column:
    """Truth of a JSON scalar given as text: words true, 1 and yes; numbers other than 0; the rest is false."""
    t = F.lower(strip(c))
    number = t.try_cast("double")
    return F.coalesce(F.when(t.isin("true", "1", "yes"), True).when(number.isNotNull(), number != 0), F.lit(False))
