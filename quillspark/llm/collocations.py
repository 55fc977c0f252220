"""Phrases whose words keep company: frequent word sequences scored against the parts they can be cut into.

Texts fall into pieces at punctuation and line ends. Equal pieces are met once, with a multiplicity, so that
copies and stock lines cost nothing further. Word sequences are then counted by weight in two steps, both in an
embedded SQL engine that spills: each task sums those of its own pieces and sends them out in compressed blocks, one for each
hash bucket; a bucket adds up what came. Only sequences that are frequent enough leave it. A candidate asks for the counts of
its parts: requests travel to the part's count, and parts that very many ask for are broadcast instead.
"""

from __future__ import annotations

import contextlib
import re
import shutil
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, staged, trimmed

#: What ends a piece.
CUTS = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Different pieces, and bytes of them, that a task sums up before it sends them on.
HELD_PIECES, HELD_BYTES = 200_000, 1 << 25
#: Memory of the embedded engine, beyond which it spills; bytes of pieces made into sequences at once; rows of a block at most.
ENGINE_MEMORY, STEP_BYTES, BLOCK_ROWS = "320MB", 1 << 21, 250_000
#: Parts that are asked for most are broadcast, at most so many.
MOST_HOT = 10_000

PIECE = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])
GRAM = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("m", pa.int64())])
BLOCK = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("grams", pa.binary()), ("m", pa.binary())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, piece and multiplicity; words are joined by one blank, A to Z in lower case."""
    held: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    n = size = 0

    def flush():
        for lang, counts in held.items():
            texts = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), texts, pa.array(counts.values(), pa.int64())], schema=PIECE)
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            own = held[lang]
            for part in CUTS.split(text.as_py().lower()):
                if piece := b" ".join(part.split()):
                    if piece not in own:
                        n, size = n + 1, size + len(piece)
                    own[piece] += 1
            if n > HELD_PIECES or size > HELD_BYTES:
                yield from flush()
                n = size = 0
    yield from flush()


@contextlib.contextmanager
def _engine():
    """An embedded SQL engine of one task, with a folder to spill to that goes with it."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="grams-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": ENGINE_MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _query(con, schema: pa.Schema, batches: Iterable[pa.RecordBatch], sql: str, rows: int) -> pa.RecordBatchReader:
    con.register("incoming", pa.RecordBatchReader.from_batches(schema, batches))
    return con.sql(sql).to_arrow_reader(rows)


def _grams(pieces: Iterable[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Sequences of 1 to ``longest`` words with their weights, and the number of words of each lang as the empty sequence."""
    words_of: dict[str, int] = defaultdict(int)
    todo = [iter(pieces)]
    while todo:
        b = next(todo[-1], None)
        if b is None:
            todo.pop()
            continue
        if b.nbytes > STEP_BYTES and b.num_rows > 1:
            half = b.num_rows // 2
            todo.append(iter((b.slice(0, half), b.slice(half))))
            continue
        lists = pc.split_pattern(b.column("piece"), " ")
        words, at = lists.flatten(), np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
        langs, m = b.column("lang"), b.column("m").to_numpy()
        codes = langs.dictionary_encode()
        sums = np.bincount(codes.indices.to_numpy()[at], weights=None, minlength=len(codes.dictionary)) if (m == 1).all() else None
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            words_of[lang] += int(sums[k]) if sums is not None else int(m[at][codes.indices.to_numpy()[at] == k].sum())
        gram = words
        for k in range(1, longest + 1):
            if len(at) < k:
                break
            if k > 1:
                gram = pc.binary_join_element_wise(gram.slice(0, len(at) - k + 1), words.slice(k - 1), " ")
            whole = at[: len(at) - k + 1] == at[k - 1 :]
            of = at[: len(at) - k + 1][whole]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(of)), gram.filter(pa.array(whole)), pa.array(m[of])], schema=GRAM)
    yield pa.RecordBatch.from_arrays([pa.array(words_of.keys(), pa.string()), pa.array([""] * len(words_of), pa.string()), pa.array(words_of.values(), pa.int64())], schema=GRAM)


def _block(bucket: int, lang: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Sequences of one lang, joined by line feeds (no sequence holds one) and compressed, with their weights."""
    t = pa.Table.from_batches(parts).combine_chunks()
    grams = t.column("gram").chunk(0)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), grams), "\n")
    packed = [zstandard.compress(x) for x in (joined[0].as_buffer(), t.column("m").to_numpy())]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([lang]), *(pa.array([x], pa.binary()) for x in packed)], schema=BLOCK)


def _unpacked(lang: str, grams: bytes, m: bytes) -> pa.RecordBatch:
    weights = np.frombuffer(zstandard.decompress(m), "int64")
    words = pc.split_pattern(pa.array([zstandard.decompress(grams)], pa.binary()).cast(pa.string()), "\n").flatten()
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(weights)), words, pa.array(weights)], schema=GRAM)


def _gather(buckets: int, longest: int):
    """Pieces of one hash range to blocks of summed sequences, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as one, _engine() as two:
            pieces = _query(one, PIECE, batches, "SELECT lang, piece, sum(m)::BIGINT AS m FROM incoming GROUP BY ALL", 2048)
            sql = f"SELECT (hash(lang, gram) % {buckets})::INTEGER AS bucket, lang, gram, sum(m)::BIGINT AS m FROM incoming GROUP BY ALL ORDER BY bucket, lang"
            held, now, rows = [], None, 0
            for b in _query(two, GRAM, _grams(pieces, longest), sql, 65_536):
                own, langs = b.column(0).to_numpy(), b.column(1).dictionary_encode()
                codes = langs.indices.to_numpy()
                edges = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (codes[1:] != codes[:-1]), True]) if len(own) else np.zeros(1, int)
                for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    key = int(own[start]), langs[start].as_py()
                    if held and (key != now or rows >= BLOCK_ROWS):
                        yield _block(*now, held)
                        held, rows = [], 0
                    now = key
                    held.append(pa.RecordBatch.from_arrays([c.slice(start, stop - start) for c in b.columns[1:]], schema=GRAM))
                    rows += stop - start
            if held:
                yield _block(*now, held)

    return run


def _count(least: int):
    """Blocks of a bucket to the sequences that occur ``least`` times or more, and to the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (_unpacked(lang.as_py(), grams.as_py(), m.as_py()) for b in batches for lang, grams, m in zip(*b.columns[1:]))
        with _engine() as con:
            sql = f"SELECT lang, gram, sum(m)::BIGINT AS m FROM incoming GROUP BY ALL HAVING sum(m) >= {least} OR gram = ''"
            for b in _query(con, GRAM, blocks, sql, 65_536):
                yield pa.RecordBatch.from_arrays(b.columns, schema=GRAM)

    return run


def counted(df: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, f of the sequences of 1 to ``longest`` words that occur ``least`` times; the empty one has the number of all words."""
    n = partitions(df.sparkSession)
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    pieces = texts.mapInArrow(trimmed(_pieces), "lang string, piece string, m long").repartition(n, "lang", "piece")
    blocks = pieces.mapInArrow(trimmed(_gather(n, longest)), "bucket int, lang string, grams binary, m binary").repartitionById(n, F.col("bucket"))
    return blocks.mapInArrow(trimmed(_count(least)), "lang string, gram string, f long")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _with_counts(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """``requests`` (lang, part, ...) with ``f``, the count of the part.

    A part is hot if more than a share of 1 / ``MOST_HOT`` of all requests are for it, so there can't be more hot parts than
    that: those are broadcast. The others meet their count by a shuffle, which no key can dominate.
    """
    total = requests.count()
    asked = requests.groupBy("lang", "part").count().filter(F.col("count") * MOST_HOT > total).select("lang", "part")
    hot = staged(counts.withColumnRenamed("gram", "part").join(F.broadcast(asked), ["lang", "part"]).select("lang", "part", F.col("f").alias("hot")), "hot-parts")
    seen = requests.join(F.broadcast(hot), ["lang", "part"], "left")
    rest = seen.filter("hot is null").drop("hot").join(counts.withColumnRenamed("gram", "part"), ["lang", "part"])
    return rest.unionByName(seen.filter("hot is not null").withColumnRenamed("hot", "f"))


def collocations(df: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each lang.

    Candidates are sequences of 2 to ``longest`` words within a piece that occur a >= ``least`` times. A cut gives a
    first part that occurs l and a rest that occurs r times, and the score floor(1000000 * a * a / (l * r)); the lowest
    score counts, of equal ones the earliest cut. A candidate that stands inside a longer one with at least ``share``
    percent of its occurrences is left out. n are all words of the lang. Order: score, a (both falling), phrase by bytes.
    Sums are 64 bits wide; scores go through decimals, which are exact up to a of 10^15.

    A null lang counts as ``und``, with those that say so; null, empty and blank texts have no words; repeated rows
    count each; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    counts = staged(counted(df, longest, least, text_col, lang_col), "sequences")
    grams, totals = counts.filter("gram <> ''"), counts.filter("gram = ''").select("lang", F.col("f").alias("n"))
    words = F.split("gram", " ")
    found = grams.withColumn("w", words).filter("size(w) > 1")
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    sides = F.array(F.struct(F.lit(True).alias("first"), _part(F.col("w"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("part")))
    asked = found.select("lang", "gram", F.col("f").alias("a"), "w", cut).select("lang", "gram", "a", "k", F.explode(sides).alias("x"))
    replies = _with_counts(staged(asked.select("lang", "gram", "a", "k", F.col("x.first").alias("first"), F.col("x.part").alias("part")), "requests"), grams)
    side = lambda first: F.max(F.when(F.col("first") == F.lit(first), F.col("f")))
    cuts = replies.groupBy("lang", "gram", "a", "k").agg(side(True).alias("l"), side(False).alias("r"))
    wide = lambda c: f"cast({c} as decimal(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    scored = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "gram", "a", "s.l", "s.r", "s.score")
    lengths = F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("z")
    inner = found.filter("size(w) > 2").select("lang", "f", "w", lengths).select("lang", "f", "w", "z", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("z") + 1)).alias("s"))
    inner = inner.select("lang", _part(F.col("w"), F.col("s"), F.col("z")).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    kept = scored.join(inner, ["lang", "gram"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "gram")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
