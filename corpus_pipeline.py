"""Corpus preparation: a chain of operators over ``documents``, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, langid, mixing, ngram_join, packing
from quillspark.llm.common import keyed, passing_tables, staged, without_keys


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language can't be told; pages that show a document add their evidence.

    Rows are judged one by one: of rows that repeat an id, those that are told stay. Null, empty and
    letterless texts go. An empty table stays empty; columns of any name are kept.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table, key = keyed(docs, "doc_id")
    found = staged(langid.identify(table, langid.page_evidence(pages), key_col=key), "languages")
    return without_keys(table, key, found.filter("not accepted").select("row_key"), docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; see ``exact_dedup.keep_first_copies`` for nulls and repeated ids."""
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words and a similarity of 0.8, the defaults for near-duplicates; one row of each component
    stays, and all rows without words; see ``ngram_join.keep_one_of_each``."""
    return ngram_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as drawn; a null source is a source, a null text has no volume, rows of one id draw alike."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, placed; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]
#: The tokenizer's ids can't be had in SQL, so the chain is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage stores besides its result goes when the stage is done.

    Nulls, repeated rows, empty tables and extra columns have the results that the stages name; an empty
    table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing_tables(spark) as lasting:
            docs = lasting(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
