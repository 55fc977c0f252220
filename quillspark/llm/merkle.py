"""Merkle manifest of a table: a tree of digests for each group, and a tree over the groups.

Ranks come from a radix trie over the ids: rows are counted by the id's leading digits, level by level, and
the counts of smaller siblings add up to an exact rank, so nothing is sorted as a whole. The digits of a
rank in the tree's fanout then key the nodes: rows that share all but their last ``STRIDE`` digits are one
block of at most ``fanout ** STRIDE`` rows, which a task reduces to its node. Nodes form blocks by the digits
that are left, until each group has one. Proofs go down the same blocks, each adding its own siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, spread_join, staged

#: Digits of a rank that one block covers, in the fanout of the tree.
STRIDE = 8
#: Bits of an id that one level of the radix trie covers, and distinct rows of one id beyond which digests are ranked by digits too.
DIGIT_BITS, ROWS_AN_ID = 8, 4096
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the joined parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: ``-`` for a null, else byte count, colon and value of each field."""
    said = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return digest(*(said(c) for c in fields))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, leaf, shown, n) with ``first``, how many rows of the group come before.

    Ids ascend, null first; rows of one id go by digest, as their order is otherwise open.
    """
    known = F.col("id").isNotNull().cast("int")
    bounds = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    low, high, depth = bounds["low"] or 0, bounds["high"] or 0, 1
    while depth * DIGIT_BITS < 64 and low >> (DIGIT_BITS * depth) != high >> (DIGIT_BITS * depth):
        depth += 1
    # Columns that key each level of the trie, finest first; each is found from the one before.
    levels = [["g", "known", "p"]] * depth
    fine = rows.select("g", known.alias("known"), F.shiftright(F.coalesce("id", F.lit(0).cast("long")), DIGIT_BITS).alias("p"), "id", "leaf", "n")
    per_id = fine.groupBy("g", "id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    bytes_ = 0
    while per_id > ROWS_AN_ID << (8 * bytes_):
        bytes_ += 1
    if bytes_:  # an id of very many different rows: digits of the digest follow those of the id
        levels = [["g", "known", "p", "id", "head"], *levels]
    fine = fine.withColumn("head", F.hex(F.substring("leaf", 1, bytes_)))
    keys = levels[0]
    counts = [staged(fine.groupBy(*keys).agg(F.sum("n").alias("n")), "digits")]
    for k, names in enumerate(levels[1:] + [["g"]]):
        shift = "p" in names and len(levels[k]) == len(names)
        coarser = counts[-1].withColumn("p", F.shiftright("p", DIGIT_BITS)) if shift else counts[-1]
        counts.append(coarser.groupBy(*names).agg(F.sum("n").alias("n")))
    before = counts[-1].select("g", F.lit(0).cast("long").alias("first"))
    for names, coarse, table in zip(reversed(levels), reversed(levels[1:] + [["g"]]), reversed(counts[:-1])):
        shift = "p" in coarse and len(coarse) == len(names)
        up = table.withColumn("up", F.shiftright("p", DIGIT_BITS)) if shift else table.withColumn("up", F.col("p"))
        over = ["g", *(["known"] if "known" in coarse else []), *(["up"] if "p" in coarse else [])]
        run = W.partitionBy(*over).orderBy(*[c for c in names if c != "g"]).rowsBetween(W.unboundedPreceding, -1)
        up = up.withColumn("_own", F.coalesce(F.sum("n").over(run), F.lit(0)))
        parents = before.withColumnRenamed("p", "up")
        before = up.join(parents, over).select(*names, (F.col("first") + F.col("_own")).alias("first"))
    table = rows.withColumn("known", known).withColumn("p", F.shiftright(F.coalesce("id", F.lit(0).cast("long")), DIGIT_BITS)).withColumn("head", F.hex(F.substring("leaf", 1, bytes_)))
    joined = table.join(before, [table[k].eqNullSafe(before[k]) if k == "id" else table[k] == before[k] for k in keys]).select(*(table[c] for c in table.columns), before["first"])
    run = W.partitionBy(*keys).orderBy("id", "leaf", "shown").rowsBetween(W.unboundedPreceding, -1)
    return joined.select("g", "id", "leaf", "shown", "n", (F.col("first") + F.coalesce(F.sum("n").over(run), F.lit(0))).alias("first"))


def _height(n: Column, fanout: int) -> Column:
    """How often ``n`` nodes are reduced until one is left."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 63]
    return F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in powers)), lambda x: x < n))


def _levels(digests: Column, height: Column, fanout: int) -> Column:
    """The digests of a block, of their parents, and so on for ``height`` steps, as an array of arrays."""

    def parents(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / fanout).cast("int")), lambda j: digest(F.array_join(F.slice(held, j * fanout + 1, F.lit(fanout)), "")))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(digests), lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1)))))


def _siblings(levels: Column, at: Column, height: Column, fanout: int) -> Column:
    """What stands left and right of the node in its run, for each step from place ``at`` of the block."""
    powers = F.array(*(F.lit(fanout**k) for k in range(STRIDE + 1)))

    def step(k: Column) -> Column:
        place, level = F.floor(at / F.get(powers, k)).cast("int"), F.get(levels, k)
        own = place % fanout
        left = F.slice(level, place - own + 1, own)
        right = F.slice(level, place + 2, F.lit(fanout - 1) - own)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    steps = F.when(height > 0, F.sequence(F.lit(0), height - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, step)


def _text(c: Column) -> Column:
    return F.lower(F.hex(c))


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (g, pos, height, item with a ``digest``) by block: g, block, height still to go, items by place."""
    size = fanout**STRIDE
    grouped = nodes.groupBy("g", F.floor(F.col("pos") / size).cast("long").alias("block"), "height")
    return grouped.agg(F.array_sort(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("at"), "item"))).alias("items"))


def _with_levels(blocks: DataFrame, fanout: int) -> DataFrame:
    here = F.least("height", F.lit(STRIDE)).cast("int")
    return blocks.withColumn("here", here).withColumn("levels", _levels(F.transform("items", lambda x: _text(x["item"]["digest"])), here, fanout))


def _tops(blocks: DataFrame, fanout: int) -> DataFrame:
    """The node that each block reduces to, as the nodes of the next pass."""
    top = F.unhex(F.get(F.element_at("levels", -1), F.lit(0)))
    made = _with_levels(blocks, fanout)
    return made.select("g", F.col("block").alias("pos"), F.greatest(F.col("height") - STRIDE, F.lit(0)).alias("height"), F.struct(top.alias("digest")).alias("item"))


def _paths(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """g, pos, item and path of each node in ``blocks``; ``above`` has the path of each block (g, block, path)."""
    each = _with_levels(blocks.join(above, ["g", "block"]), fanout).select("g", "block", "path", "here", "levels", F.explode("items").alias("x"))
    own = _siblings(F.col("levels"), F.col("x.at"), F.col("here"), fanout)
    return each.select("g", (F.col("block") * fanout**STRIDE + F.col("x.at")).alias("pos"), F.col("x.item").alias("item"), F.concat(own, "path").alias("path"))


def _tree(nodes: DataFrame, tallest: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of each pass, and the one node that each g ends with."""
    passes = []
    for _ in range(max(1, -(-tallest // STRIDE))):
        passes.append(staged(_blocks(nodes, fanout), "blocks"))
        nodes = _tops(passes[-1], fanout)
    return passes, nodes


def _down(passes: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """Paths of the lowest nodes; ``above`` has that of each g (g, path)."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(passes[1:]):
        above = _paths(blocks, above, fanout).select("g", F.col("pos").alias("block"), "path")
    return _paths(passes[0], above, fanout)


def _in_order(groups: DataFrame) -> DataFrame:
    """``groups`` with ``pos``, their rank by g: ranges of keys are counted, then numbered inside."""
    parts = staged(groups.repartitionByRange(partitions(groups.sparkSession), "g").withColumn("part", F.spark_partition_id()), "groups")
    sums = parts.groupBy("part").count().withColumn("first", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("part").orderBy("g")) - 1
    return parts.join(F.broadcast(sums), "part").withColumn("pos", (F.col("first") + own).cast("long")).drop("part", "count", "first")


def manifest(df: DataFrame, leaf: Column, shown: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root, verified of each row of ``df``.

    ``leaf`` is the digest of a row. The rows of a group ascend by id; while there are several nodes, each
    run of ``fanout`` becomes the digest of its joined digests (the last run may be shorter, even one). What
    is left is the subroot; subroots by group (null first, then by bytes) give the root likewise. ``path``
    is the proof, array<struct<left, right>>: what stands beside the node in its run, from the leaf up to
    the root. ``shown`` is a leaf digest to be checked (null: the leaf itself); folding it along the path gives
    folded_root, and verified says whether that is the root.

    A null id comes first in its group; rows of one id go by digest, and equal rows have neighbouring
    places, so each has a proof. A null group is a group of its own. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("-"))  # null first
    shown = F.lit(None).cast("string") if shown is None else shown
    rows = df.select(group.alias("g"), F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(shown).alias("shown"))
    rows = staged(rows.groupBy("g", "id", "leaf", "shown").agg(F.count("*").alias("n")), "leaves")
    sizes = staged(rows.groupBy("g").agg(F.sum("n").alias("size")).withColumn("height", _height(F.col("size"), fanout)), "sizes")
    ends = sizes.agg(F.count("*").alias("n"), F.max("height").alias("tallest")).first()
    each = spread_join(_ranked(rows), sizes.select("g", "height"), "g", "id")
    copies = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    nodes = each.select("g", copies.alias("pos"), "height", F.struct(F.col("leaf").alias("digest"), "id", "shown").alias("item"))
    passes, subroots = _tree(nodes, ends["tallest"] or 0, fanout)
    subroots = _in_order(subroots.select("g", F.col("item.digest").alias("subroot")))
    height = _height(F.lit(ends["n"]).cast("long"), fanout)
    tops = subroots.select(F.lit("").alias("g"), "pos", height.alias("height"), F.struct(F.col("subroot").alias("digest"), F.col("g").alias("of")).alias("item"))
    over, root = _tree(tops, df.sparkSession.range(1).select(height).first()[0], fanout)
    root = root.select(_text(F.col("item.digest"))).first()
    root = F.lit(root[0] if root else None).cast("string")
    empty = F.array().cast(PATH)
    above = _down(over, df.sparkSession.range(1).select(F.lit("").alias("g"), empty.alias("path")), fanout)
    above = staged(above.select(F.col("item.of").alias("g"), F.col("path").alias("rest"), _text(F.col("item.digest")).alias("subroot")), "groups")
    leaves = _down(passes, sizes.select("g", empty.alias("path")), fanout)
    full = spread_join(leaves, above, "g", "pos")
    full = full.select(F.col("item.id").alias("doc_id"), _text(F.col("item.digest")).alias("leaf"), _text(F.coalesce("item.shown", "item.digest")).alias("_shown"), "subroot", root.alias("root"), F.concat("path", "rest").alias("path"))
    folded = F.aggregate("path", F.col("_shown"), lambda held, x: digest(x["left"], held, x["right"]))
    out = full.withColumn("folded_root", folded)
    return out.select("doc_id", "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
