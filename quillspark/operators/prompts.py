"""Ranked sources, context blocks, grading prompts and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip

#: Characters of a candidate's text that the grader sees.
GRADED_CHARS = 2000
# Wording of the context and of the grading task.
CONTEXT_HEAD = "KONTEKST SLOVENSKE ZAKONODAJE\n\nSpodaj so pravni viri, urejeni po relevanci.\nVeč virov lahko vsebuje dodatne pogoje ali izjeme.\n\n"
GRADING_HEAD = "Ocenjuješ kakovost semantičnega iskanja za evalvacijo embedding modelov.\n\nTvoja naloga je strogo oceniti semantično relevantnost vsakega odlomka glede na poizvedbo.\n\nPoizvedba:\n"
GRADING_SCALE = """

Za VSAK odlomek določi TOČNO ENO oceno relevantnosti.

Lestvica:
0 = nerelevantno ali skoraj brez povezave s poizvedbo
1 = omenja podobno širšo temo, vendar ni dejansko relevanten
2 = delno relevantno, vsebuje nekaj povezanih informacij
3 = jasno relevantno, vendar ni osredotočeno na glavni namen poizvedbe (govori o temi, ki se neposredno navezuje na poizvedbo, vendar ne govori direktno o njej)
4 = zelo relevantno in močno povezano s poizvedbo

POMEMBNO:
- Bodi zelo diskriminativen med ocenami.
- Ne dodeljuj visokih ocen prelahko.
- Ocene 4 naj bodo redke.
- Razlikuj med širšo tematsko povezanostjo, dejansko relevantnostjo in neposrednim ujemanjem s poizvedbo.

ZELO POMEMBNO:
- Vsak odlomek MORA dobiti natanko eno oceno.
"""
GRADING_TAIL = """
- Vrni samo seznam števil kot veljaven JSON brez razlag.
- Indeks v seznamu "scores" ustreza polju "index" pri vsakem odlomku.

Vrni IZKLJUČNO JSON v tej obliki:
{
  "scores": [4,2,1,0]
}
"""
SOURCE_FIELDS = ("record_id", "law_title", "law_code", "mopedId", "article_number", "article_label", "paragraph_number", "source_type", "chapter", "article_heading", "text", "domain_tags", "cross_score")


def normalize_sources(sources: Column) -> Column:
    """Sources with their rank from 1 in front of the other fields."""
    return F.transform(sources, lambda s, i: F.struct((i + 1).alias("rank"), *(s[c].alias(c) for c in SOURCE_FIELDS)))


def context_block(rank: Column, law_title: Column, label: Column, paragraph: Column, part: Column, text: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    number = rank.cast("string")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("=== VIR ["), number, F.lit("] ===")),
        F.concat(F.lit("ZAKON: "), shown(law_title)),
        F.concat(F.lit("ČLEN: "), shown(label)),
        F.when(paragraph != "", F.concat(F.lit("ODSTAVEK: "), paragraph)),
        F.when(part != "", F.concat(F.lit("DEL ČLENA: "), part)),
        F.lit("\nBESEDILO:"),
        strip(F.coalesce(text, F.lit(""))),
        F.concat(F.lit("\n=== KONEC VIRA ["), number, F.lit("] ===")),
    )


def rag_prompts(ranked: DataFrame) -> DataFrame:
    """query_id, rag_prompt from rows with query_id, rank and the chunk fields."""
    block = context_block(F.col("rank"), F.col("law_title"), F.col("article_label"), F.col("paragraph_number"), F.col("chunk_part"), F.col("text"))
    held = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    joined = F.array_join(F.transform("held", lambda x: x["block"]), "\n\n")
    return ranked.groupBy("query_id").agg(held.alias("held")).select("query_id", F.concat(F.lit(CONTEXT_HEAD), joined).alias("rag_prompt"))


def grading_prompts(candidates: DataFrame) -> DataFrame:
    """query_id, n_candidates, prompt from rows with query_id, question, cand_pos and the chunk fields."""
    one = F.struct(
        F.col("cand_pos").alias("index"),
        F.col("law_title").alias("law"),
        F.col("law_code").alias("code"),
        F.col("article_label").alias("article"),
        F.coalesce("article_heading", F.lit("")).alias("heading"),
        F.substring("text", 1, GRADED_CHARS).alias("text"),
    )
    d = candidates.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(one)).alias("c"))
    body = F.to_json("c", {"pretty": "true", "ignoreNullFields": "false"})
    count = F.size("c")
    prompt = F.concat(F.lit(GRADING_HEAD), "question", F.lit("\n\nKandidati:\n"), body, F.lit(GRADING_SCALE), F.lit("- Število ocen mora biti TOČNO "), count.cast("string"), F.lit("."), F.lit(GRADING_TAIL))
    return d.select("query_id", count.alias("n_candidates"), prompt.alias("prompt"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system: Column, context: Column, question: Column, history: Column | None = None) -> Column:
    """System prompt, earlier turns if any, retrieved context as a system message, question."""
    tail = F.array(message("system", context), message("user", question))
    head = F.array(message("system", system))
    return F.concat(head, tail) if history is None else F.concat(head, F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), tail)


def history_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id, history: the turns of each conversation in order; an empty answer is left out, a question stays."""
    said = turns.filter((F.col("role") != "assistant") | (F.coalesce("text", F.lit("")) != ""))
    held = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("role"), F.col("text").alias("content"))))
    return said.groupBy(conv).agg(held.alias("h")).select(conv, F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))
