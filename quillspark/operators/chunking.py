"""Chunks of bounded length: units are found by markers, packed greedily, and cut where they are too long.

Markers are found by expressions. Cutting and packing go through a text step by step; that is one pass of ``functions.scan`` over the
texts that don't fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scan
from quillspark.functions.text import law_code, normalize_whitespace, strip
from quillspark.operators.segment import articles, with_clean_text
from quillspark.operators.tagging import chunk_id, domain_tags, formatted_text
from quillspark.profiles import Profile
from quillspark.schemas import CHUNK_COLUMNS

MAX_CHARS = 1500
#: A longer chunk makes its record faulty.
LONGEST_CHUNK = 20_000
SOURCE_TYPE = "COLESLAW"


_NONE = "array<string>"


def split_long(text: Column, most: int) -> Column:
    """Parts of a tidy text, see ``scan.long_parts``."""
    return scan.long_parts(text, most)


def marked(text: Column, pattern: str) -> tuple[Column, Column]:
    """What stands before the first marker, and the pieces that begin with one."""
    if not pattern:
        return text, F.array().cast(_NONE)
    gaps = F.split(text, f"(?Uud){pattern}", -1)
    found = F.regexp_extract_all(text, F.lit(f"(?Uud){pattern}"), F.lit(0))
    return F.get(gaps, F.lit(0)), F.zip_with(found, F.slice(gaps, F.lit(2), F.size(gaps)), lambda m, g: F.concat(m, F.coalesce(g, F.lit(""))))


def units(body: Column, profile: Profile) -> Column:
    """Units of the first kind of marker that gives more than one: inner articles, paragraphs, list items; else none."""
    filled = lambda c: F.filter(c, lambda x: x != "")
    none = F.array().cast(_NONE)
    head, parts = marked(body, profile.internal_article)
    inner = F.when(F.size(parts) > 1, filled(F.concat(F.array(strip(head)), F.transform(parts, normalize_whitespace))))
    _, parts = marked(body, profile.paragraph)  # what stands before the first paragraph is lost
    paragraphs = filled(F.transform(parts, normalize_whitespace))
    out = F.coalesce(inner, F.when(F.size(paragraphs) > 1, paragraphs))
    for pattern in (profile.numbered_item, profile.lettered_item):
        head, parts = marked(body, pattern)
        lead = strip(head)
        items = F.transform(parts, lambda x, i: F.when((i == 0) & (lead != ""), normalize_whitespace(F.concat(lead, F.lit("\n"), normalize_whitespace(x)))).otherwise(normalize_whitespace(x)))  # noqa: B023
        out = F.coalesce(out, F.when(F.size(parts) > 0, F.when(F.size(filled(items)) > 1, items).otherwise(none)))
    return F.coalesce(out, none)


def pack(parts: Column, most: int) -> Column:
    """Neighbouring units joined by line feeds while they fit; a unit that is too long stands alone, cut."""
    return scan.packed(F.filter(F.transform(parts, lambda x: normalize_whitespace(F.coalesce(x, F.lit("")))), lambda x: x != ""), most)


def _by_units(body: Column, found: Column, most: int) -> Column:
    several = F.size(found) > 1
    return F.when(F.length(body) <= most, F.array(body)).when(several, pack(F.when(several, found), most)).otherwise(split_long(F.when(~several, body), most))


def split_body(body: Column, most: int, profile: Profile) -> Column:
    """Parts of a tidy text by its markers, else by length."""
    return _by_units(body, units(F.when(F.length(body) > most, body), profile), most)


def chunks(records: DataFrame, profile: Profile, max_chars: int = MAX_CHARS, keep_nonparsed: bool = False, with_records: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks of records (record_pos and the seven record fields), ordered by record_pos, article_idx, part_idx.

    Articles are split by ``split_body``; a record without articles gives, if ``keep_nonparsed``, parts of its whole
    text. Empty chunks are left out, after their number was counted. Columns: the three ordinals and the chunk fields.
    ``with_records`` names columns of the records to be kept as well, and adds a row of article_idx -1 for each record itself.
    """
    whole = F.lit(False) if with_records is None else F.col("article_idx") == -1
    clean = with_clean_text(records, "text", profile, "_clean")
    found = articles(clean, "_clean", profile, keep_bare=keep_nonparsed, with_whole=with_records is not None)
    bare = F.col("article_idx").isNull()
    if keep_nonparsed:  # a record without articles is one without a number, cut by length alone
        found = found.filter(~bare | (F.col("whole_text") != ""))
    # Columns of their own, as each expression would else hold many copies of those it is made of.
    found = found.withColumn("_long", F.when(F.length("article_body") > max_chars, F.col("article_body"))).withColumn("_units", units(F.col("_long"), profile))
    by_marker = _by_units(F.col("article_body"), F.col("_units"), max_chars)
    found = found.withColumn("_always", bare).withColumn("_parts", F.when(bare, split_long(F.col("whole_text"), max_chars)).otherwise(by_marker) if keep_nonparsed else by_marker)
    parsed = found.withColumn("article_idx", F.coalesce("article_idx", F.lit(0))).drop("_clean", "whole_text", "text", "_long", "_units")
    many = F.size("_parts") > 1
    each = parsed.select("*", many.alias("_many"), F.size("_parts").alias("_n"), F.posexplode_outer("_parts").alias("part_idx", "_text"))
    index = F.col("part_idx") + 1
    each = each.withColumn("chunk_part", F.when(F.col("_many"), F.concat(index.cast("string"), F.lit("/"), F.col("_n").cast("string"))))
    each = each.withColumn("law_code", law_code(F.coalesce("naziv", F.lit(""))))
    none, kept = F.lit(None).cast("string"), with_records or ()
    out = each.select(
        *kept,
        "record_pos",
        "article_idx",
        "part_idx",
        chunk_id(F.col("mopedId"), F.col("article_number"), none, F.when(F.col("_many") | F.col("_always"), index)).alias("chunk_id"),
        F.col("id").alias("record_id"),
        F.col("naziv").alias("law_title"),
        "law_code",
        "mopedId",
        "eva",
        "epa",
        "sop",
        "chapter",
        "article_number",
        "article_label",
        "article_heading",
        none.alias("paragraph_number"),
        "chunk_part",
        domain_tags(F.col("law_code"), F.col("naziv"), F.col("_text"), profile).alias("domain_tags"),
        F.lit(SOURCE_TYPE).alias("source_type"),
        strip(F.make_valid_utf8("_text")).alias("text"),
        formatted_text(F.col("naziv"), F.col("law_code"), F.col("chapter"), F.col("article_label"), F.col("article_heading"), none, F.col("chunk_part"), F.col("_text")).alias("formatted_text"),
    )
    return out.filter((F.col("text") != "") | whole).select("record_pos", "article_idx", "part_idx", *CHUNK_COLUMNS, *kept)
