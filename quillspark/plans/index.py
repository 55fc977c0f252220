"""Flow A: records to chunks, quarantine and counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.operators import chunking, relevance, reports
from quillspark.profiles import SLOVENIAN_LAW, Profile
from quillspark.schemas import CHUNK_COLUMNS
from quillspark.sources.readers import spread
from quillspark.sources.store import stored

#: Fields of a record's row that tell which it is.
CHUNK_ABOUT = ("record_id", "law_title", "law_code")


@dataclass
class Index:
    chunks: DataFrame
    quarantine: DataFrame
    counters: DataFrame
    filter_reasons: DataFrame
    records_by_law: DataFrame
    chunks_by_law: DataFrame | None
    tag_counts: DataFrame | None


def build_index(records: DataFrame, profile: Profile = SLOVENIAN_LAW, strategy: str = "normal", max_chars: int = chunking.MAX_CHARS, keep_nonparsed: bool | None = None, min_keyword_matches: int = 2, columns: Sequence[str] = CHUNK_COLUMNS) -> Index:
    """``records`` has record_pos and the seven record fields.

    Kept records without chunks, or with a chunk over the length limit, go to the quarantine with an error;
    their chunks and tags are not counted. The records are read once: one pass writes their chunks and a row for each
    record, and is watched for the counts that a pass can tell; all else comes from what it wrote. ``columns`` names the
    fields of the chunks to be made and written: who asks for counts alone needs no texts. Counts of fields left out are None.
    """
    options = dict(relevance.STRATEGIES[strategy])
    parse_all = options.pop("keep_nonparsed", False) if keep_nonparsed is None else keep_nonparsed
    options.pop("keep_nonparsed", None)
    seen = relevance.with_reason(relevance.normalize_records(spread(records, "record_pos")), profile, min_keyword_matches=min_keyword_matches, **options)
    is_kept = F.col("reason").isin(*relevance.KEPT_REASONS)
    searched = seen.withColumn("text", F.when(is_kept, F.col("text")))  # others leave their record row alone
    rows = chunking.chunks(searched, profile, max_chars, parse_all, with_records=("reason", "error")).withColumn("n_chars", F.length("text"))
    whole = F.col("article_idx") == -1
    watch = Observation()
    rows = rows.observe(
        watch,
        F.count_if(whole).alias("records_total"),
        F.count_if(whole & is_kept).alias("records_kept"),
        F.count_if(whole & F.col("reason").isin(*relevance.DROPPED_REASONS)).alias("records_skipped"),
        F.count_if(whole & F.col("error").isNotNull()).alias("records_unreadable"),
    )
    run = stored(rows.select("record_pos", "article_idx", "part_idx", *dict.fromkeys((*CHUNK_ABOUT, *columns)), "reason", "error", "n_chars"), "run")
    about = F.struct(F.col("record_id").alias("id"), F.col("law_title").alias("naziv"), "law_code", "reason", "error")
    made = run.groupBy("record_pos").agg(F.max(F.when(whole, about)).alias("r"), F.count_if(~whole).alias("n_chunks"), F.max("n_chars").alias("longest"))
    fault = F.when(F.col("n_chunks") == 0, "no chunks").when(F.col("longest") > chunking.LONGEST_CHUNK, "chunk too long")
    each = made.select("record_pos", "r.*", "n_chunks", "longest").withColumn("kept", is_kept)
    each = stored(each.withColumn("error", F.coalesce("error", F.when(F.col("kept"), fault))), "outcome")
    faulty = each.filter("error is not null")
    good = run.filter(~whole).join(faulty.select("record_pos"), "record_pos", "left_anti").select("record_pos", "article_idx", "part_idx", *columns)
    return Index(
        chunks=good,
        quarantine=faulty.select("record_pos", "id", "naziv", "error"),
        counters=reports.record_counters(each.filter("kept"), watch.get),
        filter_reasons=reports.counts(each.filter("reason is not null"), F.col("reason"), "reason"),
        records_by_law=reports.counts(each.filter("kept"), F.col("law_code"), "law_code"),
        chunks_by_law=reports.counts(good, F.col("law_code"), "law_code") if "law_code" in columns else None,
        tag_counts=reports.tag_counts(good) if "domain_tags" in columns else None,
    )


def require_chunks(index: Index) -> Index:
    """The index, or an error where no record gave a chunk."""
    if index.chunks.isEmpty():
        raise ValueError("no chunks were made: nothing to embed")
    return index
