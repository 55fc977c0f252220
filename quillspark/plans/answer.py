"""Flow B: questions to ranked sources and prompts; flow C: graded candidates to NDCG statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import ndcg, prompts, retrieval


def ranked_sources(chunks: DataFrame, questions: DataFrame, k: int = 50, n: int = 10, metric: str = "ip", mode: str = "online", scorer=None) -> DataFrame:
    """The n best chunks of each question after the rerank: query_id, question, rank, the scores and the chunk fields.

    ``chunks`` has chunk_pos, embedding and chunk fields; ``questions`` query_id, question and embedding. Only the k
    retrieved chunks of a question are joined with their texts, and only they reach the reranker.
    """
    found = retrieval.top_k(chunks, questions, k, metric)
    texts = chunks.drop("embedding")
    wide = found.join(texts, "chunk_pos").join(questions.select("query_id", "question"), "query_id")
    wide = wide.withColumn("_passage", retrieval.rerank_text(F.col("law_title"), F.col("text"), F.col("formatted_text"), mode))
    return retrieval.rerank(retrieval.with_cross_score(wide, "question", "_passage", scorer), n).drop("_passage")


def prompts_for(chunks: DataFrame, questions: DataFrame, system_prompt: str, history: DataFrame | None = None, **options) -> DataFrame:
    """query_id, messages: what goes to the language model."""
    context = prompts.rag_prompts(ranked_sources(chunks, questions, **options))
    d = questions.select("query_id", "question").join(context, "query_id")
    if history is not None:
        d = d.join(history, "query_id", "left")
    said = F.col("history") if history is not None else None
    return d.select("query_id", prompts.chat_messages(F.lit(system_prompt), F.col("rag_prompt"), F.col("question"), said).alias("messages"))


def retrieval_quality(candidates: DataFrame, grades: DataFrame, reranked: bool = False, last_k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Values by query and k, and their summary; candidates rank by cross_score or by distance, nearest first."""
    graded = ndcg.with_grades(candidates, grades)
    predicted = F.coalesce("cross_score", -F.col("score")) if reranked else -F.col("score")
    values = ndcg.ndcg(graded.withColumn("predicted", predicted), last_k=last_k)
    return values, ndcg.ndcg_summary(values)
