"""Chat formatting by cumulative-snapshot collapse.

Chat logs often store a conversation again after every turn. Each turn is hashed together with its place,
and running exclusive-or of these hashes gives the hash of every turn prefix (128 bits). A conversation
whose full hash is a proper prefix hash of a longer one is a snapshot of it; an anti-join drops it. Equal
conversations leave the one with the smallest id. Up to here no text is shuffled, only digests. The turns of
what stays are then picked by a semi-join and rendered by a template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import staged
from quillspark.llm.passing import Passing

#: A turn is rendered as START role BREAK text END.
START, BREAK, END = "<|", "|>\n", "<|end|>\n"
#: Maximal conversations of at most so many rows (some megabytes) are broadcast.
BROADCAST_KEPT = 50_000


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, sha; role and text are never null."""
    rows = df.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("sha", F.sha2(F.concat_ws("\x1f", "role", "text"), 256))


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct turns with their place in the conversation, from 1, in the order of turn, role and digest."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "sha")
    same = F.lag(F.struct("turn", "role", "sha")).over(order)
    rows = rows.withColumn("again", F.coalesce(same.eqNullSafe(F.struct("turn", "role", "sha")), F.lit(False))).filter("not again")
    return rows.withColumn("place", F.row_number().over(order)).drop("again")


def _prefixes(turns: DataFrame) -> DataFrame:
    run = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = turns.select("conv_id", "place", F.xxhash64("place", "sha").alias("a"), F.xxhash64("sha", "place", F.lit(7)).alias("b"))
    return here.select(
        "conv_id",
        "place",
        F.bit_xor("a").over(run).alias("h1"),
        F.bit_xor("b").over(run).alias("h2"),
        F.count(F.lit(1)).over(W.partitionBy("conv_id")).alias("n_turns"),
    )


def maximal_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged of each conversation that prefixes no longer one; n_logged counts equal ones."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col).drop("text")
    prefixes = _prefixes(_placed(rows))
    full = prefixes.filter("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    inner = prefixes.filter("place < n_turns").groupBy("place", "h1", "h2").agg(F.count(F.lit(1)).alias("n_longer")).drop("n_longer")
    return full.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_logged")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_logged, rendered: one row for each maximal conversation.

    Turns are ordered by turn, role and digest; a turn that repeats number, role and text counts once. A
    null role or text is empty, a null turn number comes first, rows without conversation id are left out, an
    empty table gives an empty result, other columns are ignored.
    """
    kept = staged(maximal_conversations(df, conv_col, turn_col, role_col, text_col), "maximal")
    part = F.concat(F.lit(START), "role", F.lit(BREAK), "text", F.lit(END))
    turns = _rows(df, conv_col, turn_col, role_col, text_col).select("conv_id", "turn", "role", "sha", part.alias("part"))
    # Snapshots lose their texts before the shuffle: by a broadcast of few kept ids, else by a filter of bounded size.
    if kept.count() <= BROADCAST_KEPT:
        kept = F.broadcast(kept)
    else:
        turns = Passing(kept.select("conv_id")).probe(turns)
    turns = turns.join(kept, "conv_id")
    each = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "sha", "part")
    whole = turns.groupBy("conv_id", "n_turns", "n_logged").agg(F.array_sort(F.collect_set(each)).alias("parts"))
    rendered = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return whole.select("conv_id", "n_turns", "n_logged", rendered.alias("rendered"))
