"""Domain tags, formatted text and identifiers of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.needles import groups_found
from quillspark.profiles import Profile


def domain_tags(code: Column, title: Column, text: Column, profile: Profile) -> Column:
    """Sorted distinct tags, by law code or by words in title and text without regard to case."""
    hay = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    by_code = [F.when(F.coalesce(code.isin(*codes), F.lit(False)), F.lit(tag)) for tag, codes in sorted(profile.code_tags.items()) if codes]
    of_code = F.array_compact(F.array(*by_code)) if by_code else F.array().cast("array<string>")
    return F.array_sort(F.array_union(of_code, groups_found(hay, profile.word_tags)))


def formatted_text(title: Column, code: Column, chapter: Column, label: Column, heading: Column, paragraph: Column, part: Column, text: Column) -> Column:
    """Labelled parts joined by " | "; empty and null parts are left out, the text always stands last."""
    said = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    point = F.when(paragraph.endswith(")") | paragraph.endswith("."), F.concat(F.lit("Odstavek/točka: "), paragraph)).otherwise(F.concat(F.lit("Odstavek: ("), paragraph, F.lit(")")))
    return F.concat_ws(
        " | ",
        said("Zakon", title),
        said("Oznaka", code),
        said("Poglavje", chapter),
        said("Člen", label),
        said("Naslov člena", heading),
        F.when(paragraph != "", point),
        said("Del člena", part),
        F.concat(F.lit("Besedilo: "), F.coalesce(text, F.lit(""))),
    )


def chunk_id(moped: Column, article: Column, paragraph: Column, index: Column) -> Column:
    """{moped}_A{article}_P{paragraph} with _S{index} where there is an index. Not unique: never join on it."""
    given = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.concat(given(moped, "NO_MOPED"), F.lit("_A"), given(article, "DOC"), F.lit("_P"), given(paragraph, "FULL"), F.coalesce(F.concat(F.lit("_S"), index.cast("string")), F.lit("")))
