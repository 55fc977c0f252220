"""Flow D: predictions to judgments and rates, with the judge (or the chat model) as a function."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import judging, ndcg


def tried(client: Callable[[str], str], fail_fast: bool = False, tries: int = 1, wait: float = 1.0) -> Callable[[str], tuple[str | None, str | None]]:
    """``client`` as a function that gives a reply or an error, after ``tries`` calls with waits that double from ``wait`` seconds."""

    def ask(text: str) -> tuple[str | None, str | None]:
        for left in reversed(range(tries)):
            try:
                return client(text), None
            except Exception as e:
                if left:
                    time.sleep(wait * 2 ** (tries - 1 - left))
                elif fail_fast:
                    raise
                else:
                    return None, f"{type(e).__name__}: {e}"

    return ask


def call_model(requests: DataFrame, column: str, client: Callable[[str], str], out: str = "reply", fail_fast: bool = False, tries: int = 1, wait: float = 1.0, at_once: int = 1) -> DataFrame:
    """Adds the reply of ``client`` to each request and call_error, null where the call went well; see ``tried``.

    A task has ``at_once`` calls open. Where a run is long or may break, ``journal.ask_all`` writes each reply as it comes.
    """
    ask = tried(client, fail_fast, tries, wait)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for texts in batches:
                yield pd.DataFrame(list(pool.map(ask, texts)), columns=["reply", "error"])

    called = F.pandas_udf(run, "reply string, error string", F.PandasUDFType.SCALAR_ITER)
    return requests.withColumn("_call", called.asNondeterministic()(F.col(column))).withColumn(out, F.col("_call.reply")).withColumn("call_error", F.col("_call.error")).drop("_call")


def predictions(gold: DataFrame, answered: DataFrame, model: str, limit: int | None = None, order: str = "item_pos") -> DataFrame:
    """Gold items with what was answered: id, question, gold_answer, gold_sources, prediction.

    ``answered`` has id, answer, sources and error. An item without an answer row, or with an error, gets the failure form: no answer,
    no sources, the error. ``limit`` takes the first items by ``order``.
    """
    items = gold if limit is None else gold.orderBy(order).limit(limit)
    found = answered.select(F.col("id").alias("_id"), "answer", "sources", "error", F.lit(True).alias("_seen"))
    d = items.join(found, F.col("id") == F.col("_id"), "left")
    error = F.when(F.col("_seen").isNull(), F.lit("no answer")).otherwise(F.col("error"))
    sources = F.when(error.isNull(), F.col("sources"))
    none = F.array().cast(answered.schema["sources"].dataType)
    said = F.struct(F.when(error.isNull(), F.col("answer")).alias("answer"), F.coalesce(sources, none).alias("sources"), F.lit(model).alias("model"), error.alias("error"))
    return d.select("id", "question", "gold_answer", "gold_sources", said.alias("prediction"))


def graded(prompts: DataFrame, client: Callable[[str], str], size: int = ndcg.GRADING_BATCH, tries: int = 3, wait: float = 1.0, at_once: int = 8) -> DataFrame:
    """query_id, cand_pos, grade from prompts (query_id, batch, prompt): every batch is asked alone, some at a time.

    A reply that is no list of scores counts as a failed call and is asked again; a batch that fails for good, and
    candidates that a reply leaves out, have no grade, which ``with_grades`` reads as 0.
    """

    def strict(text: str) -> str:
        reply = client(text)
        if not isinstance(json.loads(reply)["scores"], list):
            raise TypeError("scores are no list")
        return reply

    replied = call_model(prompts, "prompt", strict, tries=tries, wait=wait, at_once=at_once)
    return ndcg.batch_grades(replied.select("query_id", "batch", ndcg.parse_scores(F.col("reply")).alias("scores")), size)


def judge(predictions: DataFrame, client: Callable[[str], str], judge_model: str, fail_fast: bool = False) -> DataFrame:
    """id, question, gold_answer, model_answer, judgment, judge_model, error."""
    asked = predictions.withColumn("_request", judging.judge_input(predictions))
    replied = call_model(asked, "_request", client, fail_fast=fail_fast).withColumn("_p", judging.parse_reply(F.col("reply")))
    error = F.coalesce("call_error", F.col("_p.error"))
    fields = [F.col(f"_p.{f}").alias(f) for f in (*judging.FLAGS, "rationale")]
    verdict = F.when(error.isNull(), F.struct(*fields, F.col("reply").alias("raw_judge_response")))
    return replied.select("id", "question", "gold_answer", F.col("prediction.answer").alias("model_answer"), verdict.alias("judgment"), F.lit(judge_model).alias("judge_model"), error.alias("error"))


def judge_rates(judged: DataFrame) -> DataFrame:
    flat = judged.select("error", *(F.col(f"judgment.{f}").alias(f) for f in judging.FLAGS))
    return judging.judge_summary(flat)
