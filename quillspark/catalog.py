"""Every registered query of the retrieval pipeline with its DuckDB counterpart.

The given tables stand in for a corpus of acts: ``documents`` for records (source as law code),
``embeddings`` for chunk and query vectors, ``benchmark`` for questions, ``labels`` for verdicts and
``conversations`` for history and answers. Their texts have no headings, so ``article_segments`` puts
articles, titles and chapters before their lines. ``CORPUS`` holds words of these texts in place of legal terms.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import chunking, compare, embedding, judging, ndcg, prompts, relevance, reports, retrieval, segment, tagging, vector_index
from quillspark.plans import evaluate, index, journal
from quillspark.profiles import SLOVENIAN_LAW
from quillspark.sources import store, token_stream
from quillspark.sources.readers import spread
from quillspark.streaming import history

CORPUS = replace(
    SLOVENIAN_LAW,
    law_codes=("src1", "src2", "src3"),
    title_keywords=("src7", "SRC19"),
    text_keywords=("That ", "Einv", "cióne", "éleau", "ouel", "shing"),
    code_tags={"first": ("src1", "src2"), "second": ("src3",), "third": ("src0",)},
    word_tags={"english": ("the ", "thing"), "german": ("und ", "schein"), "french": ("eau ", "ment"), "spanish": ("ción", " que ")},
)
K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_pos"), "embedding"), e.select(F.col("vec_id").alias("query_id"), "embedding")


def _top(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return retrieval.top_k(*_vectors(spark, d), k=K, metric=metric, decimals=6)

    return run


def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = V.normalized(F.col("embedding"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.norm(n), 5).alias("norm_after"), F.round(F.element_at(n, 1), 5).alias("first"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("record_pos"), F.col("doc_id").alias("id"), F.concat(F.lit("Zakon "), "lang", F.lit(" ("), "source", F.lit(")")).alias("naziv"), F.concat(F.lit("M"), "doc_id").alias("mopedId"), none.alias("eva"), none.alias("epa"), none.alias("sop"), "text"
    )


def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    return relevance.with_reason(relevance.normalize_records(_records(spark, d)), CORPUS, min_keyword_matches=4).select("id", "reason", T.law_code(F.col("naziv")).alias("law_code"), T.keyword_hits(F.col("text"), list(CORPUS.text_keywords)).alias("text_hits"))


def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts(relevance_filter(spark, d), F.col("reason"), "reason")


def strict_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = relevance.with_reason(_records(spark, d), CORPUS, strict_whitelist=True)
    return reports.counts(r, F.col("reason"), "reason")


def records_by_law(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts(_records(spark, d), T.law_code(F.col("naziv")), "law_code")


def top30_laws(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_counts(_records(spark, d), T.law_code(F.col("naziv")), "record_pos", "law_code")


def _tags():
    return tagging.domain_tags(T.law_code(F.col("naziv")), F.col("naziv"), F.col("text"), CORPUS)


def domain_tags(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", _tags().alias("domain_tags"))


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.tag_counts(domain_tags(spark, d))


def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.concat("text", F.lit("\r\n\n\n\t"), "source")).alias("text"))


def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("text"), T.word_count(F.col("text")).alias("n_words"))


def formatted_text(spark: SparkSession, d: str) -> DataFrame:
    r, none = _records(spark, d), F.lit(None).cast("string")
    part = F.when(F.col("id") % 2 == 0, F.lit("1/2"))
    made = tagging.formatted_text(F.col("naziv"), T.law_code(F.col("naziv")), none, F.concat("id", F.lit(". člen")), F.lit(""), F.when(F.col("id") % 3 == 0, F.lit("2)")).otherwise("2"), part, F.col("text"))
    return r.select("id", made.alias("formatted_text"), T.embedding_text(made).alias("embedding_text"), tagging.chunk_id(F.col("mopedId"), F.col("id").cast("string"), none, F.when(F.col("id") % 2 == 0, F.lit(1))).alias("chunk_id"), T.slug(F.col("text")).alias("slug"))


HEADING_CHARS = 40


def line_asof_heading(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document with the last short line at or before them; a short line counts as heading here."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    rows = rows.withColumn("own", F.when((F.length("value") < HEADING_CHARS) & (F.length("value") > 0), F.col("value")))
    return segment.asof_heading(rows, "doc_id", "line", "own", "heading").select("doc_id", "line", F.length("value").alias("n_chars"), "heading")


def _acts(spark: SparkSession, d: str) -> DataFrame:
    """Records whose every line of text is the body of a numbered article.

    Every third heading is of the forward style, every fifth article has a title, and a chapter begins before every eleventh.
    """

    def article(x, i):
        n = i + 1
        chapter = F.when(n % 11 == 0, F.concat((n / 11).cast("int").cast("string"), F.lit(". poglavje\n"))).otherwise("")
        heading = F.when(n % 3 == 0, F.concat(F.lit("Člen "), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(". člen")))
        title = F.when(n % 5 == 0, F.concat(F.lit("(Naslov "), n.cast("string"), F.lit(")\n"))).otherwise("")
        return F.concat(chapter, heading, F.lit("\n"), title, x)

    return _records(spark, d).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), article), "\n"))


def article_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.articles(spread(_acts(spark, d), "id"), "text", CORPUS).select("id", "article_idx", "article_number", "article_label", "article_heading", "article_body", "chapter")


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The indexing flow over these acts, all kept."""
    return index.build_index(_acts(spark, d), CORPUS, strategy="all-laws").chunks


def index_counters(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(_acts(spark, d), CORPUS, min_keyword_matches=4, columns=()).counters


def chunks_by_law(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(_acts(spark, d), CORPUS, min_keyword_matches=4, columns=("law_code",)).chunks_by_law


def chunks_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(_acts(spark, d), CORPUS, min_keyword_matches=4, columns=("domain_tags",)).tag_counts


def split_long_text(spark: SparkSession, d: str) -> DataFrame:
    parts = chunking.split_long(T.normalize_whitespace(F.col("text")), chunking.MAX_CHARS)
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.posexplode(parts).alias("part", "text"))


def pack_units(spark: SparkSession, d: str) -> DataFrame:
    parts = chunking.pack(F.split("text", "\n"), chunking.MAX_CHARS)
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.posexplode(parts).alias("part", "text"))


def _candidates(spark: SparkSession, d: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """Retrieved vectors of each vector, and as grades how near their labels are (4: the same)."""
    found = retrieval.top_k(*_vectors(spark, d), k=2 * K, metric=metric, decimals=6).withColumnRenamed("retrieval_rank", "cand_pos")
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    a = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_q"))
    b = labels.select(F.col("vec_id").alias("chunk_pos"), F.col("label").alias("_c"))
    near = found.join(a, "query_id").join(b, "chunk_pos")
    return found, near.select("query_id", "cand_pos", F.greatest(F.lit(0), 4 - F.abs(F.col("_q") - F.col("_c"))).alias("grade"))


def _ndcg_values(spark: SparkSession, d: str, metric: str = "cosine") -> DataFrame:
    found, grades = _candidates(spark, d, metric)
    sign = 1 if metric == "ip" else -1
    # Two decimals: candidates tie, as the shared gain of ties is part of the measure. Hundredths are rounded as the doubles they are, like SQL does;
    # round(x, 2) goes by the written digits, so 0.565, whose hundredfold is less than 56.5, would be 0.57.
    graded = ndcg.with_grades(found, grades).withColumn("predicted", F.round(F.col("score") * sign * 100) / 100)
    return ndcg.ndcg(graded, last_k=2 * K)


def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _ndcg_values(spark, d).withColumn("ndcg", F.round("ndcg", 6))


def ndcg_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ndcg.ndcg_summary(_ndcg_values(spark, d))
    return s.select("k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def compare_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two retrieval metrics as configurations, ordered by their mean over k."""
    both = None
    for metric in ("cosine", "l2"):
        s = ndcg.ndcg_summary(_ndcg_values(spark, d, metric)).select(F.lit(f"{metric}.json").alias("file"), F.lit("vectors").alias("embedding_model"), F.lit(metric == "l2").alias("reranking_enabled"), F.lit(metric).alias("reranking_model"), "k", "mean", "std")
        both = s if both is None else both.unionByName(s)
    out = compare.compare(compare.with_label(both, {"vectors": "Vectors", "l2": "L2"}))
    return out.withColumn("mean_ndcg", F.round("mean_ndcg", 6))


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions, with the vector of their number; all documents as chunks, vectors dealt to them in turn."""
    e = table(spark, d, "embeddings")
    size = e.agg((F.max("vec_id") + 1).alias("size"))
    docs = table(spark, d, "documents").join(F.broadcast(size), F.lit(True)).join(e, F.col("doc_id") % F.col("size") == F.col("vec_id")).drop("size")
    chunks = docs.select(F.col("doc_id").alias("chunk_pos"), "embedding")
    questions = table(spark, d, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), "embedding")
    found = retrieval.top_k(chunks, questions, k=5 * K, metric="ip", decimals=6)
    texts = docs.select(F.col("doc_id").alias("chunk_pos"), F.concat(F.lit("Zakon "), "source").alias("law_title"), F.concat("doc_id", F.lit(". člen")).alias("article_label"), "text")
    wide = found.join(texts, "chunk_pos").join(questions.select("query_id", "question"), "query_id")
    wide = wide.withColumn("passage", retrieval.rerank_text(F.col("law_title"), F.col("text"), F.lit(""), "online"))
    scored = retrieval.with_cross_score(wide, "question", "passage").withColumn("cross_score", F.round("cross_score", 9))
    return retrieval.rerank(scored, K)


def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d).select("query_id", "rank", "chunk_pos", "retrieval_rank", "score", "cross_score")


def rag_prompts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return prompts.rag_prompts(_retrieved(spark, d).withColumn("paragraph_number", none).withColumn("chunk_part", F.when(F.col("rank") % 2 == 0, F.lit("1/2"))))


def grading_prompts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c = _retrieved(spark, d).withColumn("cand_pos", F.col("rank")).withColumn("law_code", none).withColumn("article_heading", none)
    return prompts.grading_prompts(c)


def normalized_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources of each question as a list with ranks from its order, reduced to the fields that a judge sees."""
    r = _retrieved(spark, d)
    none = {c: F.lit(None).cast("string") for c in prompts.SOURCE_FIELDS if c not in r.columns}
    r = r.withColumns(none)
    held = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), *prompts.SOURCE_FIELDS)))
    listed = r.groupBy("query_id").agg(held.alias("held")).select("query_id", prompts.normalize_sources(F.col("held")).alias("sources"))
    ranks = F.transform("sources", lambda x: F.struct(x["rank"].alias("rank"), x["cross_score"].alias("cross_score")))
    both = listed.select("query_id", F.explode(F.arrays_zip(ranks.alias("r"), judging.compact_sources(F.col("sources")).alias("s"))).alias("x"))
    return both.select("query_id", "x.r.rank", "x.r.cross_score", "x.s.*")


def c_fields(df: DataFrame, column: str) -> list[str]:
    return df.select(column).schema[0].dataType.elementType.names


def judge_requests(spark: SparkSession, d: str) -> DataFrame:
    """What the judge is asked about each prediction, as far as all prediction fields are there."""
    p = _predictions(spark, d)
    full = lambda c: F.transform(c, lambda s: F.struct(*((s[f] if f in ("law_code", "article_label", "law_title") and f in c_fields(p, c) else F.lit(None).cast("string")).alias(f) for f in judging.COMPACT)))
    p = p.withColumn("gold_sources", full("gold_sources")).withColumn("prediction", F.col("prediction").withField("sources", full("prediction.sources")))
    return p.select("id", judging.judge_input(p).alias("request"))


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in vectors of all documents at their own length: four components and the sum of all squares."""
    made = embedding.embed(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), T.embedding_text(F.col("text")), normalize=False)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dimension"), squares.alias("squares"), *(F.element_at("embedding", k + 1).cast("double").alias(f"v{k}") for k in range(4)))


def positional_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    both = retrieval.chunks_with_embeddings(e.select(F.col("vec_id").alias("chunk_pos"), "label"), e.select(F.col("vec_id").alias("chunk_pos"), "embedding"))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("components"))


def grading_batches(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.top_k(*_vectors(spark, d), k=60, metric="cosine", decimals=6).withColumnRenamed("retrieval_rank", "cand_pos")
    return ndcg.grading_batches(found).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("batch_pos").alias("largest"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A judge's reply for each label: good documents are correct, toxic ones hallucinate."""
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    said = F.format_string('{"legal_correct": %s, "citation_correct": "%s", "hallucination": %d, "passed": %s, "rationale": " d%d "}', good.cast("string"), F.when(good, "Yes").otherwise("no"), F.col("toxic"), (good & ~bad).cast("string"), F.col("doc_id"))
    wrapped = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Here it is: "), said, F.lit(" Done."))).when(F.col("doc_id") % 7 == 0, F.lit('{"legal_correct": true}')).when(F.col("doc_id") % 11 == 0, F.lit("no verdict")).otherwise(said)
    return table(spark, d, "labels").select("doc_id", wrapped.alias("reply"))


def parse_judge_replies(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("doc_id", judging.parse_reply(F.col("reply")).alias("p")).select("doc_id", "p.*")


def judge_rates(spark: SparkSession, d: str) -> DataFrame:
    s = judging.judge_summary(parse_judge_replies(spark, d))
    return s.select("total", "judged", "failed", *(F.round(f"{f}_rate", 9).alias(f"{f}_rate") for f in judging.FLAGS))


def conversation_messages(spark: SparkSession, d: str) -> DataFrame:
    """System prompt, history, context and the last turn's text as question, each conversation's messages as lines."""
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("last"))
    earlier = c.join(last.select("conv_id", "last"), "conv_id").filter("turn < last")
    m = last.join(prompts.history_of(earlier), "conv_id", "left")
    said = prompts.chat_messages(F.lit("Bodi natančen."), F.lit("Brez virov."), T.query_text(F.col("question")), F.col("history"))
    return m.select("conv_id", F.size(said).alias("n_messages"), F.array_join(F.transform(said, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("messages"))


def answer_stats(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "conversations").filter("role = 'assistant'").select(F.col("text").alias("answer"), F.lit(10).alias("n_sources"), F.lit(None).cast("string").alias("error"))
    s = reports.answer_stats(a, uncertain=("nicht ", "not "), source_words=("the ", "der ", "que "))
    return s.withColumn("avg_words", F.round("avg_words", 6)).withColumn("avg_sources", F.round("avg_sources", 6))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as gold; a quarter was never answered, a sixth failed, the others echo the question."""
    b = table(spark, d, "benchmark").withColumn("id", F.col("item_id").cast("string"))
    code = lambda n: F.concat(F.lit("src"), (F.col("item_id") % n).cast("string"))
    gold = b.select("id", F.col("text").alias("question"), F.col("text").alias("gold_answer"), F.array(F.struct(code(7).alias("law_code"), code(7).alias("law_title"))).alias("gold_sources"))
    source = F.struct(F.lit(1).alias("rank"), code(5).alias("law_code"), F.concat("id", F.lit(". člen")).alias("article_label"))
    answered = b.filter("item_id % 4 <> 0").select("id", F.concat(F.lit("člen "), "text").alias("answer"), F.array(source).alias("sources"), F.when(F.col("item_id") % 6 == 0, "late").alias("error"))
    return evaluate.predictions(gold, answered, "echo")


def predictions_joined(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prediction")
    return _predictions(spark, d).select("id", "question", p["answer"].alias("answer"), F.size(p["sources"]).alias("n_sources"), p["error"].alias("error"))


def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    return reports.prediction_table(_predictions(spark, d)).withColumn("has_preview", F.col("preview") != "").drop("preview")


def most_common_laws(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    gold, top = (reports.most_common_laws(p, of, 3).select(F.lit(of).alias("side"), "law_code", "n") for of in ("gold", "predicted"))
    return gold.unionByName(top)


def retrieval_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as queries, documents as chunks: the fields that evaluation reads, some of them not given."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_pos"), "text", F.concat(F.lit("Zakon: "), "text").alias("formatted_text"), F.concat(F.lit("M"), "doc_id").alias("chunk_id"), F.concat(F.lit("Zakon "), "source").alias("law_title"))
    return retrieval.as_candidates(_top("cosine")(spark, d).join(texts, "chunk_pos"))


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{store.shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def conversation_history_stream(spark: SparkSession, d: str) -> DataFrame:
    """The conversations replayed as a stream in three batches; what each history is in the end, as lines. Every ninth turn but the first failed."""
    folder = _own_folder(spark, "replay")
    turns = table(spark, d, "conversations").withColumn("turn", F.col("turn").cast("int"))
    failed = F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 9 == 0), "HTTP 500")
    turns = turns.select("conv_id", "turn", "role", "text", failed.alias("error"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", history.PROVIDER)
    try:
        for part in ("turn < 2", "turn >= 2 and turn < 4", "turn >= 4"):  # each is met by a query of its own, which goes on from the checkpoint
            turns.filter(part).write.mode("append").parquet(f"{folder}/in")
            history.run_to_end(history.history_stream(spark.readStream.schema(history.TURN).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/mark")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    done = history.histories(spark.read.schema(history.KEPT).parquet(f"{folder}/out"))
    return done.select("conv_id", F.size("history").alias("n_messages"), F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("messages"))


def _indexed(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """All vectors as questions to a stored index of them."""
        chunks, questions = _vectors(spark, d)
        return vector_index.search_all(vector_index.build(chunks, _own_folder(spark, "vectors"), metric), questions, K, 6)

    return run


def token_stream_replies(spark: SparkSession, d: str) -> DataFrame:
    """Each turn logged as a token stream, seven characters a chunk, and put together again; every tenth never ended, every thirteenth broke off in its last chunk."""
    folder = _own_folder(spark, "tokens")
    c = table(spark, d, "conversations").filter("text <> ''").withColumn("reply", F.concat("conv_id", F.lit("-"), "turn"))
    n = F.ceil(F.length("text") / 7).cast("int")
    key = F.col("conv_id") * 31 + F.col("turn")
    broke, ended = key % 13 == 0, key % 10 != 0
    piece = lambda i: F.concat(F.lit("data: "), F.to_json(F.struct(F.col("reply").alias("id"), F.array(F.struct(F.struct(F.substring("text", i * 7 + 1, F.lit(7)).alias("content")).alias("delta"))).alias("choices"))))
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(broke & (i == n - 1), F.lit('data: {"id"')).otherwise(piece(i)))
    first = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("reply").alias("id"), F.array().cast("array<string>").alias("choices"))))
    text = F.array_join(F.concat(F.array(first), lines, F.when(ended, F.array(F.lit("data: [DONE]"))).otherwise(F.array().cast("array<string>"))), "\n\n")
    c.select(text.alias("value")).write.text(folder)
    return token_stream.replies(token_stream.read(spark, folder))


def journaled_replies(spark: SparkSession, d: str) -> DataFrame:
    """Each question's reply (its length, in place of a model) as a journal holds it; a second run over the same journal makes no call."""
    path = _own_folder(spark, "journal")
    asked = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("request"))
    answer = lambda text: str(len(text))
    journal.ask_all(asked.filter("item_id % 3 <> 0"), "id", "request", answer, path, buckets=8)
    found, called = journal.ask_all(asked, "id", "request", answer, path, buckets=8)
    return found.withColumn("called_again", F.lit(called).cast("long"))


QUERIES = {
    "vec_topk_inner_product": _top("ip"),
    "vec_topk_cosine": _top("cosine"),
    "vec_topk_l2": _top("l2"),
    "vec_index_cosine": _indexed("cosine"),
    "vec_index_l2": _indexed("l2"),
} | {
    f.__name__: f
    for f in (
        vec_normalize,
        relevance_filter,
        filter_reasons,
        strict_filter_reasons,
        records_by_law,
        top30_laws,
        domain_tags,
        tag_counts,
        normalize_whitespace,
        collapse_whitespace,
        formatted_text,
        line_asof_heading,
        article_segments,
        index_chunks,
        index_counters,
        chunks_by_law,
        chunks_by_tag,
        split_long_text,
        pack_units,
        ndcg_at_k,
        ndcg_summary,
        compare_metrics,
        rerank_topn,
        rag_prompts,
        grading_prompts,
        normalized_sources,
        judge_requests,
        embedded_documents,
        positional_join,
        grading_batches,
        parse_judge_replies,
        judge_rates,
        conversation_messages,
        answer_stats,
        predictions_joined,
        prediction_table,
        most_common_laws,
        retrieval_candidates,
        conversation_history_stream,
        journaled_replies,
        token_stream_replies,
    )
}

# ---- DuckDB counterparts ----

_SCORE = {
    "ip": "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])",
    "cosine": "1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (greatest(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 1e-10) * greatest(sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 1e-10))",
    "l2": "list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) ** 2",
}


def _top_sql(metric: str, k: int) -> str:
    order = "DESC" if metric == "ip" else "ASC"
    return f"""SELECT * FROM (SELECT query_id, chunk_pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, chunk_pos)::INTEGER AS retrieval_rank
        FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_pos, round({_SCORE[metric]}, 6) + 0.0 AS score FROM embeddings q, embeddings c)) WHERE retrieval_rank <= {k}"""


_RECORDS = "SELECT doc_id AS id, 'Zakon ' || lang || ' (' || source || ')' AS naziv, source AS law_code, text FROM documents"
_HITS = " + ".join(f"contains(lower(text), '{w.lower()}')::INTEGER" for w in CORPUS.text_keywords)
_TITLE = " OR ".join(f"contains(lower(naziv), '{w.lower()}')" for w in CORPUS.title_keywords)
_CODES = ", ".join(f"'{c}'" for c in CORPUS.law_codes)
_REASON = f"""SELECT id, CASE WHEN law_code IN ({_CODES}) THEN 'whitelist' WHEN {_TITLE} THEN 'title_keyword' WHEN {_HITS} >= 4 THEN 'text_keywords' ELSE 'irrelevant' END AS reason,
    law_code, {_HITS} AS text_hits FROM ({_RECORDS})"""


def _tags_of(title: str, text: str) -> str:
    tests = []
    for tag in sorted(set(CORPUS.code_tags) | set(CORPUS.word_tags)):
        hits = [f"law_code IN ({', '.join(repr(c) for c in CORPUS.code_tags[tag])})"] if tag in CORPUS.code_tags else []
        hits += [f"contains(lower({title} || chr(10) || {text}), '{w}')" for w in CORPUS.word_tags.get(tag, ())]
        tests.append(f"CASE WHEN {' OR '.join(hits)} THEN '{tag}' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


def _tag_sql() -> str:
    return f"SELECT id, {_tags_of('naziv', 'text')} AS domain_tags FROM ({_RECORDS})"


def _ndcg_sql(metric: str) -> str:
    sign = "" if metric == "ip" else "-"
    return f"""WITH found AS ({_top_sql(metric, 2 * K)}),
        graded AS (SELECT query_id, round({sign}score, 2) AS p, pow(2, greatest(0, 4 - abs(a.label - b.label))) - 1 AS g
                   FROM found JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_pos),
        shared AS (SELECT query_id, p, g, avg(g) OVER (PARTITION BY query_id, p) AS s, count(*) OVER (PARTITION BY query_id) AS n,
                          row_number() OVER (PARTITION BY query_id ORDER BY p DESC) AS r, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS b FROM graded),
        ks AS (SELECT unnest(range(2, {2 * K} + 1)) AS k),
        sums AS (SELECT query_id, k, max(n) AS n, sum(CASE WHEN r <= k THEN s / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= k THEN g / log2(b + 1) ELSE 0 END) AS ideal
                 FROM shared, ks GROUP BY query_id, k),
        ndcg AS (SELECT query_id, k::INTEGER AS k, CASE WHEN n = 1 THEN NULL WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END AS ndcg FROM sums)"""


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"
_RERANK = f"""WITH q AS (SELECT item_id AS query_id, b.text AS question, e.embedding FROM benchmark b JOIN embeddings e ON item_id = vec_id),
    c AS (SELECT doc_id AS chunk_pos, 'Zakon ' || source AS law_title, doc_id || '. člen' AS article_label, d.text, e.embedding FROM documents d JOIN embeddings e ON doc_id % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id),
    s AS (SELECT query_id, question, chunk_pos, law_title, article_label, text, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, c),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos)::INTEGER AS retrieval_rank FROM s) WHERE retrieval_rank <= {5 * K}),
    w AS (SELECT *, {_WORDS.format("question")} AS a, {_WORDS.format("law_title || ': ' || text")} AS b FROM f),
    x AS (SELECT *, len(list_intersect(a, b)) AS i FROM w),
    y AS (SELECT *, round(CASE WHEN len(a) + len(b) > 0 THEN i / (len(a) + len(b) - i) ELSE 0.0 END, 9) AS cross_score FROM x),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, retrieval_rank)::INTEGER AS rank FROM y) WHERE rank <= {K})"""
_BLANK = r"[\s\x0B\x{85}\x{A0}]+"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _tidy_sql(x: str) -> str:
    one = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    two = rf"regexp_replace({one}, '[\x{{A0}} \t]+', ' ', 'g')"
    return _strip_sql(rf"regexp_replace({two}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _cut_sql(texts: str, most: int) -> str:
    """Common tables that cut the texts t of ``texts`` (id, t): parts has id, n (a number that rises), part.

    Pieces of a text end where a match of its pattern ends, so running sums of their lengths give the breaks; a number takes its full stop with it.
    """
    half = most // 2
    return rf"""long AS (SELECT id, t, length(t) AS size FROM ({texts}) WHERE length(t) > {most}),
        pieces AS (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, '[0-9]+\.|[;:.]{_BLANK}|\n+|[0-9]+|[;:.]|[^;:.\n0-9]+') AS x FROM long)),
        ends AS (SELECT id, list(e) FILTER (regexp_matches(x, '^([;:.]{_BLANK}|\n+)$')) AS ends FROM
                 (SELECT id, x, sum(length(x)) OVER (PARTITION BY id ORDER BY i)::BIGINT AS e FROM pieces) GROUP BY id),
        cuts(id, n, pos, cut) AS (SELECT id, -1, 0::BIGINT, 0::BIGINT FROM long UNION ALL
                 SELECT id, n + 1, next, CASE WHEN e IS NOT NULL THEN e WHEN high < size AND back > 0 AND high - back > next THEN high - back ELSE high END
                 FROM (SELECT id, n, next, high, size, list_max(list_filter(ends, lambda e: e >= next + {half} AND e <= high)) AS e,
                              strpos(reverse(substr(t, (next + {half} + 1)::BIGINT, (high - next - {half})::BIGINT)), ' ') AS back
                       FROM (SELECT c.id, n, greatest(cut, pos + (n >= 0)::BIGINT) AS next, least(greatest(cut, pos + (n >= 0)::BIGINT) + {most}, size) AS high, size, ends, t
                             FROM cuts c JOIN long USING (id) LEFT JOIN ends USING (id) WHERE cut < size) x) y),
        parts AS (SELECT id, n, part FROM (SELECT c.id, n, {_strip_sql("substr(t, (pos + 1)::BIGINT, (cut - pos)::BIGINT)")} AS part FROM cuts c JOIN long USING (id) WHERE n >= 0) WHERE part <> '')"""


#: What makes a line a chapter heading, and a numbered one, as the profile has it; a word ends where no letter, digit or underscore follows.
_OPENS = r"[IVXLCDM]+\.\s+[A-ZČŠŽ0-9][A-ZČŠŽ0-9\s\-–,/]+|(?i:[0-9]+\.\s*(poglavje|del|oddelek)([^\p{L}\p{N}_].*)?|(PRVI|DRUGI|TRETJI|ČETRTI|PETI|ŠESTI|SEDMI|OSMI|DEVETI|DESETI|ENAJSTI|DVANAJSTI)\s+DEL([^\p{L}\p{N}_].*)?)"
_NUMBERED = r"[0-9]+\.\s+[A-ZČŠŽ][^.;:]{1,120}"
#: The articles of the acts, one a line. A line that is itself a heading has no part in a body: a chapter heading governs the articles after it (the last one before
#: an article counts, these or those put before every eleventh line), and one in parentheses is the title, where no title was put before it.
_BODY = rf"""lines AS (SELECT doc_id, 'Zakon ' || lang || ' (' || source || ')' AS naziv, source AS law_code, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    told AS (SELECT *, regexp_full_match(x, '{_OPENS}') AS opens, i % 5 <> 0 AND regexp_full_match(x, '\(.+\)') AS titled FROM (SELECT * EXCLUDE (v), {_tidy_sql("v")} AS x FROM lines)),
    body AS MATERIALIZED (SELECT doc_id, naziv, law_code, i, CASE WHEN opens OR titled OR regexp_full_match(x, '{_NUMBERED}') THEN '' ELSE x END AS t, CASE WHEN i % 3 = 0 THEN 'Člen ' || i ELSE i || '. člen' END AS label,
            CASE WHEN i % 5 = 0 THEN 'Naslov ' || i WHEN titled THEN {_strip_sql("substr(x, 2, length(x) - 2)")} END AS heading,
            CASE WHEN own.i >= i // 11 * 11 THEN own.x WHEN i >= 11 THEN (i // 11) || '. poglavje' END AS chapter
        FROM (SELECT *, last_value(CASE WHEN opens THEN {{'i': i, 'x': x}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM told))"""
#: Chunks of these articles; a line holds no markers, so only its length cuts it.
_CHUNKED = f"""WITH RECURSIVE {_BODY},
    {_cut_sql("SELECT {'doc_id': doc_id, 'i': i} AS id, t FROM body", chunking.MAX_CHARS)},
    cut AS (SELECT id.doc_id AS doc_id, id.i AS i, n, part FROM parts UNION ALL SELECT doc_id, i, 0, t FROM body WHERE length(t) <= {chunking.MAX_CHARS} AND t <> ''),
    chunked AS (SELECT body.*, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id, i) AS many, part FROM body JOIN cut USING (doc_id, i) WINDOW w AS (PARTITION BY doc_id, i ORDER BY cut.n))"""
_TAGGED = _tags_of("naziv", "part")


_PREDICTED = """WITH p AS (SELECT item_id::VARCHAR AS id, text AS question, 'src' || item_id % 7 AS gold_law, item_id % 4 <> 0 AND item_id % 6 <> 0 AS ok,
    CASE WHEN ok THEN 'člen ' || text END AS answer, CASE WHEN ok THEN 1 ELSE 0 END::INTEGER AS n_sources, CASE WHEN ok THEN 'src' || item_id % 5 END AS law, CASE WHEN ok THEN item_id || '. člen' END AS label,
    CASE WHEN item_id % 4 = 0 THEN 'no answer' WHEN item_id % 6 = 0 THEN 'late' END AS error FROM benchmark)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_REPLIES = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'good' WHEN doc_id % 7 = 0 THEN 'missing citation_correct' WHEN doc_id % 11 = 0 THEN 'no JSON object' ELSE 'good' END AS state, quality = 1 AS ok, toxic = 1 AS bad FROM labels"""
_PARSED = f"""SELECT doc_id, CASE WHEN state = 'good' THEN ok END AS legal_correct, CASE WHEN state = 'good' THEN ok END AS citation_correct, CASE WHEN state = 'good' THEN bad END AS hallucination,
    CASE WHEN state = 'good' THEN ok AND NOT bad END AS passed, CASE WHEN state = 'good' THEN 'd' || doc_id END AS rationale, CASE WHEN state <> 'good' THEN state END AS error FROM ({_REPLIES})"""

ORACLES = {
    **{name: _top_sql(metric, K) for name, metric in (("vec_topk_inner_product", "ip"), ("vec_topk_cosine", "cosine"), ("vec_topk_l2", "l2"))},
    **{f"vec_index_{metric}": _top_sql(metric, K) for metric in ("cosine", "l2")},
    "vec_normalize": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
        m AS (SELECT vec_id, norm, list_transform(e, lambda x: x / norm) AS u FROM n)
        SELECT vec_id, round(norm, 5) AS norm, round(sqrt(list_dot_product(u, u)), 5) AS norm_after, round(u[1], 5) + 0.0 AS first FROM m""",
    "relevance_filter": _REASON,
    "filter_reasons": f"SELECT reason, count(*) AS n FROM ({_REASON}) GROUP BY reason",
    "strict_filter_reasons": f"SELECT CASE WHEN source IN ({_CODES}) THEN 'whitelist' ELSE 'not_in_whitelist' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "records_by_law": "SELECT source AS law_code, count(*) AS n FROM documents GROUP BY 1",
    "top30_laws": "SELECT source AS law_code, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 30",
    "domain_tags": _tag_sql(),
    "tag_counts": f"SELECT tag, count(*) AS n FROM (SELECT unnest(domain_tags) AS tag FROM ({_tag_sql()})) GROUP BY tag",
    "normalize_whitespace": f"SELECT doc_id, {_tidy_sql('text || chr(13) || chr(10) || chr(10) || chr(10) || chr(9) || source')} AS text FROM documents",
    "collapse_whitespace": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x{85}\x{A0}]+', ' ', 'g')) AS text FROM documents)
        SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INTEGER AS n_words FROM t""",
    "formatted_text": r"""WITH f AS (SELECT doc_id AS id, 'Zakon: Zakon ' || lang || ' (' || source || ') | Oznaka: ' || source || ' | Člen: ' || doc_id || '. člen | ' ||
            CASE WHEN doc_id % 3 = 0 THEN 'Odstavek/točka: 2)' ELSE 'Odstavek: (2)' END || CASE WHEN doc_id % 2 = 0 THEN ' | Del člena: 1/2' ELSE '' END || ' | Besedilo: ' || text AS formatted_text, text FROM documents)
        SELECT id, formatted_text, 'passage: ' || formatted_text AS embedding_text, 'M' || id || '_A' || id || '_PFULL' || CASE WHEN id % 2 = 0 THEN '_S1' ELSE '' END AS chunk_id,
            regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 60), '[^\p{L}\p{M}\p{N}\p{Pc}\s-]', '', 'g'), '\s+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM f""",
    "line_asof_heading": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
        SELECT doc_id, line::INTEGER AS line, length(value)::INTEGER AS n_chars,
            last_value(CASE WHEN length(value) < 40 AND length(value) > 0 THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM l""",
    "article_segments": f"WITH {_BODY} SELECT doc_id AS id, (i - 1)::INTEGER AS article_idx, i::VARCHAR AS article_number, label AS article_label, heading AS article_heading, t AS article_body, chapter FROM body",
    "split_long_text": f"""WITH RECURSIVE texts AS MATERIALIZED (SELECT doc_id AS id, {_tidy_sql("text")} AS t FROM documents), {_cut_sql("SELECT id, t FROM texts", chunking.MAX_CHARS)}
        SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INTEGER AS part, part AS text
        FROM (SELECT id, n, part FROM parts UNION ALL SELECT id, 0, t FROM texts WHERE length(t) <= {chunking.MAX_CHARS})""",
    "pack_units": f"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        units AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, u, length(u) AS size FROM (SELECT doc_id, i, {_tidy_sql("u")} AS u FROM lines) WHERE u <> ''),
        held(doc_id, i, pack, room) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM units UNION ALL
                 SELECT u.doc_id, u.i, pack + CASE WHEN size < room THEN 0 ELSE 1 END, CASE WHEN size > {chunking.MAX_CHARS} THEN 0 WHEN size < room THEN room - size - 1 ELSE {chunking.MAX_CHARS} - size END
                 FROM held h JOIN units u ON u.doc_id = h.doc_id AND u.i = h.i + 1),
        packs AS (SELECT doc_id, pack, string_agg(u, chr(10) ORDER BY i) AS t FROM held JOIN units USING (doc_id, i) GROUP BY doc_id, pack),
        {_cut_sql("SELECT {'doc_id': doc_id, 'pack': pack} AS id, t FROM packs", chunking.MAX_CHARS)},
        mixed AS (SELECT id.doc_id AS doc_id, id.pack AS pack, n, part FROM parts UNION ALL SELECT doc_id, pack, 0, t FROM packs WHERE length(t) <= {chunking.MAX_CHARS})
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pack, n) - 1)::INTEGER AS part, part AS text FROM mixed""",
    "index_chunks": f"""{_CHUNKED} SELECT doc_id AS record_pos, (i - 1)::INTEGER AS article_idx, (n - 1)::INTEGER AS part_idx,
            'M' || doc_id || '_A' || i || '_PFULL' || CASE WHEN many > 1 THEN '_S' || n ELSE '' END AS chunk_id, doc_id AS record_id, naziv AS law_title, law_code, 'M' || doc_id AS mopedId,
            NULL::VARCHAR AS eva, NULL::VARCHAR AS epa, NULL::VARCHAR AS sop, chapter, i::VARCHAR AS article_number, label AS article_label, heading AS article_heading, NULL::VARCHAR AS paragraph_number,
            CASE WHEN many > 1 THEN n || '/' || many END AS chunk_part, {_TAGGED} AS domain_tags, 'COLESLAW' AS source_type, part AS text,
            concat_ws(' | ', 'Zakon: ' || naziv, 'Oznaka: ' || law_code, 'Poglavje: ' || chapter, 'Člen: ' || label, 'Naslov člena: ' || heading, CASE WHEN many > 1 THEN 'Del člena: ' || n || '/' || many END, 'Besedilo: ' || part) AS formatted_text
        FROM chunked""",
    "index_counters": f"""{_CHUNKED}, r AS (SELECT id, reason <> 'irrelevant' AS kept FROM ({_REASON})), m AS (SELECT id, kept, count(part) AS n FROM r LEFT JOIN chunked ON doc_id = id GROUP BY id, kept)
        SELECT count(*) AS records_total, count(*) FILTER (kept) AS records_kept, count(*) FILTER (NOT kept) AS records_skipped, 0::BIGINT AS records_unreadable, count(*) FILTER (kept AND n > 0) AS records_with_chunks,
            count(*) FILTER (kept AND n = 0) AS records_no_chunks, count(*) FILTER (kept AND n = 0) AS records_faulty, coalesce(sum(n) FILTER (kept), 0)::BIGINT AS chunks_total FROM m""",
    "chunks_by_law": f"{_CHUNKED} SELECT law_code, count(*) AS n FROM chunked WHERE doc_id IN (SELECT id FROM ({_REASON}) WHERE reason <> 'irrelevant') GROUP BY law_code",
    "chunks_by_tag": f"{_CHUNKED} SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGGED}) AS tag FROM chunked WHERE doc_id IN (SELECT id FROM ({_REASON}) WHERE reason <> 'irrelevant')) GROUP BY tag",
    "predictions_joined": _PREDICTED + " SELECT id, question, answer, n_sources, error FROM p",
    "prediction_table": _PREDICTED
    + f""" SELECT id, CASE WHEN answer IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(answer, '{_BLANK}'), lambda x: x <> '')) END::INTEGER AS answer_words, n_sources AS num_sources,
        law AS top_pred_law, label AS top_pred_article, gold_law AS gold_laws, contains(lower(coalesce(answer, '')), 'ne vem') AS has_uncertainty, answer IS NOT NULL AS has_source_reference, answer IS NOT NULL AS has_preview FROM p""",
    "most_common_laws": _PREDICTED
    + """ SELECT * FROM (SELECT 'gold' AS side, gold_law AS law_code, count(*) AS n FROM p GROUP BY 2 ORDER BY n DESC, law_code LIMIT 3)
        UNION ALL SELECT * FROM (SELECT 'predicted', law, count(*) AS n FROM p WHERE law IS NOT NULL GROUP BY 2 ORDER BY n DESC, law LIMIT 3)""",
    "retrieval_candidates": f"""SELECT query_id, retrieval_rank, d.text, 'Zakon: ' || d.text AS formatted_text, score AS dist, 'M' || doc_id AS chunk_id, 'Zakon ' || source AS law_title, '' AS law_code, '' AS article_label, '' AS article_heading
        FROM ({_top_sql("cosine", K)}) JOIN documents d ON doc_id = chunk_pos""",
    "ndcg_at_k": _ndcg_sql("cosine") + " SELECT query_id, k, round(ndcg, 6) AS ndcg FROM ndcg",
    "ndcg_summary": _ndcg_sql("cosine") + " SELECT k, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS std, count(ndcg) AS n FROM ndcg GROUP BY k",
    "compare_metrics": f"""SELECT file, label, round(avg(mean), 6) AS mean_ndcg, count(*) AS n_k, true AS has_std FROM (
        SELECT 'cosine.json' AS file, 'Vectors' AS label, k, avg(ndcg) AS mean FROM ({_ndcg_sql("cosine")} SELECT * FROM ndcg) GROUP BY k UNION ALL
        SELECT 'l2.json', 'Vectors + L2', k, avg(ndcg) FROM ({_ndcg_sql("l2")} SELECT * FROM ndcg) GROUP BY k) GROUP BY file, label""",
    "rerank_topn": _RERANK + " SELECT query_id, rank, chunk_pos, retrieval_rank, score, cross_score FROM r",
    "rag_prompts": _RERANK
    + f""", b AS (SELECT query_id, rank, '=== VIR [' || rank || '] ===' || chr(10) || 'ZAKON: ' || law_title || chr(10) || 'ČLEN: ' || article_label || chr(10) ||
            CASE WHEN rank % 2 = 0 THEN 'DEL ČLENA: 1/2' || chr(10) ELSE '' END || chr(10) || 'BESEDILO:' || chr(10) || {_strip_sql("text")} || chr(10) || chr(10) || '=== KONEC VIRA [' || rank || '] ===' AS block FROM r)
        SELECT query_id, '{prompts.CONTEXT_HEAD}' || string_agg(block, chr(10) || chr(10) ORDER BY rank) AS rag_prompt FROM b GROUP BY query_id""",
    "normalized_sources": _RERANK + " SELECT query_id, rank, cross_score, law_title, NULL::VARCHAR AS law_code, article_label, NULL::VARCHAR AS paragraph_number, text FROM r",
    "grading_prompts": _RERANK
    + f""", j AS (SELECT query_id, question, count(*) AS n, string_agg('{{' || chr(10) || '  "index" : ' || rank || ',' || chr(10) || '  "law" : ' || to_json(law_title) || ',' || chr(10) || '  "code" : null,' || chr(10) ||
            '  "article" : ' || to_json(article_label) || ',' || chr(10) || '  "heading" : "",' || chr(10) || '  "text" : ' || to_json(substr(text, 1, 2000)) || chr(10) || '}}', ', ' ORDER BY rank) AS body FROM r GROUP BY query_id, question)
        SELECT query_id, n::INTEGER AS n_candidates, {_quoted(prompts.GRADING_HEAD)} || question || chr(10) || chr(10) || 'Kandidati:' || chr(10) || '[ ' || body || ' ]' || {_quoted(prompts.GRADING_SCALE)} ||
            '- Število ocen mora biti TOČNO ' || n || '.' || {_quoted(prompts.GRADING_TAIL)} AS prompt FROM j""",
    "judge_requests": _PREDICTED
    + f""" SELECT id, {_quoted(judging.INSTRUCTION)} || '{{' || chr(10) || '  "id" : ' || to_json(id) || ',' || chr(10) || '  "question" : ' || to_json(question) || ',' || chr(10) || '  "gold_answer" : ' || to_json(question) || ',' || chr(10) ||
            '  "gold_sources" : [ {{' || chr(10) || '    "law_title" : "' || gold_law || '",' || chr(10) || '    "law_code" : "' || gold_law || '",' || chr(10) || '    "article_label" : null,' || chr(10) || '    "paragraph_number" : null,' || chr(10) || '    "text" : null' || chr(10) || '  }} ],' || chr(10) ||
            '  "model_answer" : ' || coalesce(to_json(answer)::VARCHAR, 'null') || ',' || chr(10) || '  "model_sources" : [ ' || CASE WHEN ok THEN '{{' || chr(10) || '    "law_title" : null,' || chr(10) || '    "law_code" : "' || law || '",' || chr(10) || '    "article_label" : "' || label || '",' || chr(10) ||
            '    "paragraph_number" : null,' || chr(10) || '    "text" : null' || chr(10) || '  }} ' ELSE '' END || '],' || chr(10) || '  "prediction_error" : ' || coalesce('"' || error || '"', 'null') || chr(10) || '}}' AS request FROM p""",
    "positional_join": "SELECT label, count(*) AS n, sum(len(embedding))::BIGINT AS components FROM embeddings GROUP BY label",
    "grading_batches": f"""SELECT (retrieval_rank - 1) // 25 AS batch, count(*) AS n, max((retrieval_rank - 1) % 25 + 1) AS largest FROM ({_top_sql("cosine", 60)}) GROUP BY 1""",
    "parse_judge_replies": _PARSED,
    "judge_rates": f"""SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS judged, count(*) FILTER (error IS NOT NULL) AS failed, """
    + ", ".join(f"round(avg({f}::INTEGER) FILTER (error IS NULL), 9) AS {f}_rate" for f in judging.FLAGS)
    + f" FROM ({_PARSED})",
    "conversation_messages": f"""WITH last AS (SELECT conv_id, max(turn) AS t, max_by(text, turn) AS question FROM conversations GROUP BY conv_id),
        h AS (SELECT c.conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations c JOIN last USING (conv_id) WHERE turn < t AND (role <> 'assistant' OR text <> '') GROUP BY c.conv_id)
        SELECT conv_id, (3 + coalesce(n, 0))::INTEGER AS n_messages, 'system: Bodi natančen.' || chr(10) || coalesce(said || chr(10), '') || 'system: Brez virov.' || chr(10) || 'user: ' || substr(replace({_strip_sql("question")}, 'passage:', ''), 1, 800) AS messages
        FROM last LEFT JOIN h USING (conv_id)""",
    "conversation_history_stream": """SELECT conv_id, count(*)::INTEGER AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations
        WHERE (turn = 0 OR (conv_id + turn) % 9 <> 0) AND (role <> 'assistant' OR text <> '') GROUP BY conv_id""",
    "embedded_documents": f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower('passage: ' || text), '{_BLANK}'), lambda x: x <> '')) AS w FROM documents),
        h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w), v AS (SELECT doc_id, h % 64 AS k, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY 1, 2)
        SELECT doc_id, 64::INTEGER AS dimension, sum(x * x) AS squares, """
    + ", ".join(f"coalesce(sum(x) FILTER (k = {k}), 0.0)::DOUBLE + 0.0 AS v{k}" for k in range(4))
    + " FROM v GROUP BY doc_id",
    "token_stream_replies": """SELECT conv_id || '-' || turn AS reply, CASE WHEN (conv_id * 31 + turn) % 13 = 0 THEN substr(text, 1, ((length(text) - 1) // 7 * 7)) ELSE text END AS answer,
        CASE WHEN (conv_id * 31 + turn) % 13 = 0 THEN 'broken' WHEN (conv_id * 31 + turn) % 10 <> 0 THEN 'finished' ELSE 'unfinished' END AS state FROM conversations WHERE text <> ''""",
    "journaled_replies": "SELECT item_id::VARCHAR AS id, length(text)::VARCHAR AS reply, NULL::VARCHAR AS call_error, (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0) AS called_again FROM benchmark",
    "answer_stats": r"""WITH a AS (SELECT text, lower(text) AS l, list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}]+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant')
        SELECT count(*) AS total, count(*) FILTER (text <> '') AS with_answer, count(*) FILTER (text = '') AS without_answer, 0::BIGINT AS with_error,
            count(*) FILTER (contains(l, 'nicht ') OR contains(l, 'not ')) AS uncertain, count(*) FILTER (contains(l, 'the ') OR contains(l, 'der ') OR contains(l, 'que ')) AS names_source,
            round(avg(len(w)) FILTER (text <> ''), 6) AS avg_words, 10.0::DOUBLE AS avg_sources FROM a""",
}
