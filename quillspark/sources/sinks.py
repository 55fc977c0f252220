"""Writers: Parquet as the store, JSON lines and JSON documents for exchange."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import slug

METRICS = {"cosine": "ip", "l2": "l2"}


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, nulls written out, overwriting."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_store(chunks: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The canonical store, optionally in a folder for each value of a column (such as law_code), so that scans prune."""
    writer = chunks.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def index_metric(name: str) -> str:
    """The scan metric that serves a flat index of that name."""
    if name not in METRICS:
        raise ValueError(f"unknown index metric: {name}")
    return METRICS[name]


def report(counters: DataFrame, **tables: tuple[DataFrame, str]) -> dict:
    """One mapping of the counters row and, by name, small (key column, n) tables."""
    row = counters.first()
    out = row.asDict() if row else {}
    for name, (df, key) in tables.items():
        out[name] = {r[key]: r["n"] for r in df.collect()}
    return out


def write_json(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)


def ndcg_document(summary: DataFrame, **about) -> dict:
    """The result document of a configuration: what it is and {"ndcg@k": {mean, std, n}}."""
    rows = summary.orderBy("k").collect()
    return {**about, "average_results": {f"ndcg@{r['k']}": {"mean": r["mean"], "std": r["std"], "n": r["n"]} for r in rows}}


def judge_document(summary: DataFrame, judge_model: str) -> dict:
    """The summary document of a judge; rates that do not exist, as every call failed, are left out."""
    return {"judge_model": judge_model, **{k: v for k, v in summary.first().asDict().items() if v is not None}}


def write_query_artifacts(df: DataFrame, slug_name: str, path: str) -> None:
    """Per-query artefacts (prompts, grades) in a folder for each slug."""
    df.write.mode("overwrite").partitionBy(slug_name).json(path)


def write_text(df: DataFrame, column: Column, path: str) -> None:
    df.select(column.alias("value")).write.mode("overwrite").text(path)


def slug_column(c: Column) -> Column:
    return F.coalesce(F.nullif(slug(c), F.lit("")), F.lit("query"))
