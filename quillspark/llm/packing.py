"""Best-fit packing of token pieces by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits into one sequence. The linear program covers the
histogram with as few configurations as possible. Multiplicative weights play its dual: each length has a
weight that shrinks as the length gets covered. A knapsack dynamic program prices the configuration of the
largest weight and, from the same table, the best one with each length; all that come near the largest take a
step, those of the least covered lengths first. Weights over the largest configuration are a dual solution, so every
round also proves a lower bound. Amounts are then rounded, and the pieces left over are packed best-fit.
Plain best-fit is a solution of the program too, and stays if no rounding needs fewer sequences.

Only the histogram (at most ``capacity`` rows) reaches the driver. Each task numbers its own pieces of each
length, sums of the counts turn that into a rank over the whole table, and the rank alone gives sequence
and offset, so no piece waits for another and a length that most pieces share is not gathered anywhere.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import staged, trimmed

CAPACITY = 2048
END_ID = 0
#: Rounds of the multiplicative-weights solver at most; what is not covered by then goes to the rounding.
ROUNDS = 250
#: Exponent of the weights, share of the largest weight that a configuration may lack, share of the pieces that a step takes.
ETA, NEAR, STEP = 1.0, 0.02, 0.5
#: Size of the random tie-breaking among equal fillers (weights of full sequences are about 1), and its seed.
TIES, TIE_SEED = 1e-3, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_encoders: dict = {}


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """The byte-level BPE of a rank file, one for each Python worker. Strings of ``special`` give their id."""
    key = (ranks_path, pattern, tuple(special.items()))
    if key not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise(ranks_path: str, pattern: str, special: dict[str, int], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(ranks_path, pattern, special), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(enc.encode(text.as_py() or "", allowed_special="all") + [end_id], dtype="<u4")
                for k, (start, length) in enumerate(_cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def price(weight: np.ndarray, sizes: np.ndarray, liking: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """An unbounded knapsack by dynamic programming over the room: the largest weight, and an item of (nearly) such a filling.

    ``sizes`` rise; rows of ``liking`` are added in turn to choose among near-equal items. -1: nothing fits.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        n = fitting[room]
        value = weight[:n] + best[room - sizes[:n]]
        best[room] = value.max()
        value += liking[room % len(liking)][:n]
        choice[room] = value.argmax()
    return best, choice


def fillings(sizes: np.ndarray, choice: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[list[Counter], np.ndarray]:
    """For each size the configuration that holds it and fills the rest as ``choice`` says, and its weight."""
    items, value = [Counter((k,)) for k in range(len(sizes))], weight.copy()
    room = capacity - sizes
    live = np.flatnonzero(room >= sizes[0])
    while len(live):
        k = choice[room[live]]
        value[live] += weight[k]
        room[live] -= sizes[k]
        for i, j in zip(live.tolist(), k.tolist()):
            items[i][j] += 1
        live = live[room[live] >= sizes[0]]
    return items, value


@dataclass
class Solution:
    """Configurations (sorted tuples of (length, copies)) with fractional amounts that make up the histogram; no solution's value lies below ``bound``."""

    amounts: dict[tuple, float]
    value: float
    bound: float


def configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Solution:
    amounts: dict[tuple, float] = defaultdict(float)
    demand = {x: n for x, n in histogram.items() if n}
    full = demand.pop(capacity, 0)
    if full:  # a full piece can share its sequence with nothing
        amounts[((capacity, 1),)] = float(full)
    lengths = np.array(sorted(demand), dtype=np.int64)
    wanted = np.array([demand[x] for x in lengths.tolist()], dtype=float)
    left, bound, random = wanted.copy(), 0.0, np.random.default_rng(TIE_SEED)
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 1e-6 * wanted)
        if not len(open_):
            break
        sizes, share = lengths[open_], left[open_] / wanted[open_]
        weight = sizes / capacity * np.exp(ETA * (share - share.mean()))
        liking = TIES * (0.2 * np.log(left[open_]) + random.gumbel(size=(7, len(sizes))))
        best, choice = price(weight, sizes, liking, capacity)
        bound = max(bound, float(wanted[open_] @ weight) / best[capacity])
        items, value = fillings(sizes, choice, weight, capacity)
        near = np.flatnonzero(value >= (1 - NEAR) * best[capacity])
        near = near if len(near) else value.argmax()[None]
        rest = left[open_]
        for i in near[np.argsort(-share[near], kind="stable")].tolist():
            held, copies = np.array(list(items[i])), np.array(list(items[i].values()))
            most = (rest[held] / copies).min()
            if most > 1e-9:
                amount = most if most <= 0.05 else most * STEP
                rest[held] -= copies * amount
                amounts[tuple(sorted((int(sizes[k]), int(c)) for k, c in items[i].items()))] += amount
        left[open_] = np.maximum(0.0, rest)
    for config, amount in by_itself(lengths, left, capacity):
        amounts[config] += amount
    return Solution(dict(amounts), sum(amounts.values()), bound + full)


def by_itself(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[tuple, float]]:
    """What is still left, each length by itself."""
    for x, amount in zip(lengths.tolist(), left.tolist()):
        if amount > 0:
            yield ((x, capacity // x),), amount / (capacity // x)


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over a histogram, equal bins together: configurations with their multiplicities."""
    bins: dict[int, Counter] = {}
    rooms: list[int] = []  # of the bins that are not full, sorted

    def put(room: int, config: tuple, times: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            insort(rooms, room)
        bins[room][config] += times

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = min(n, capacity // length)
                times = n // per
                put(capacity - per * length, ((length, per),), times)
                n -= per * times
                continue
            room = rooms[at]
            held = next(iter(bins[room]))
            k = min(n, bins[room][held])
            bins[room][held] -= k
            if not bins[room][held]:
                del bins[room][held]
            if not bins[room]:
                del bins[room], rooms[at]
            grown = Counter(dict(held))
            grown[length] += 1
            put(room - length, tuple(sorted(grown.items())), k)
            n -= k
    return sum(bins.values(), Counter())


def rounded(amounts: dict[tuple, float], histogram: Counter, capacity: int, least_fill: int, up_from: float) -> Counter:
    """Whole multiplicities of the configurations filled at least to ``least_fill``; what is left goes best-fit.

    Amounts are rounded down, but up for configurations filled at least to ``up_from`` while the pieces are there.
    """
    left, out = Counter(histogram), Counter()
    for config, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        fill = sum(x * n for x, n in config)
        if fill < least_fill:
            continue
        k = int(np.ceil(amount - 1e-6) if fill >= up_from else np.floor(amount + 1e-6))
        k = min([k, *(left[x] // n for x, n in config)])
        if k:
            out[config] += k
            for x, n in config:
                left[x] -= n * k
    out.update(best_fit(+left, capacity))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Configurations with whole multiplicities that hold the histogram exactly: the best of three roundings of the
    program's solution, or plain best-fit where that needs fewer sequences."""
    demand = Counter({k: v for k, v in histogram.items() if v})
    amounts = configuration_lp(demand, capacity).amounts
    ways = ((capacity, np.inf), (capacity, capacity), (0, capacity))
    found = [rounded(amounts, demand, capacity, *way) for way in ways]
    return min([*found, best_fit(demand, capacity)], key=lambda c: sum(c.values()))


def _slots(configs: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, copies a sequence, first sequence, first offset, of each configuration that has it."""
    rows, rank, sequence = defaultdict(list), Counter(), 0
    for config, times in sorted(configs.items()):
        offset = 0
        for length, copies in config:
            rows[length].append((rank[length], copies, sequence, offset))
            rank[length] += copies * times
            offset += copies * length
        sequence += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for length, r in rows.items()}


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            values, at = np.unique(length[order], return_index=True)
            for value, rows in zip(values, np.split(order, at[1:])):
                first, copies, base, start = table[int(value)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                i = rank[rows] - first[k]
                sequence[rows], offset[rows] = base[k] + i // copies[k], start[k] + i % copies[k] * value
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    ranks_path: str = public_tokenizers.path("byte_bpe_50k.tiktoken"),
    pattern: str = public_tokenizers.PATTERN,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``. Documents longer than ``capacity`` are cut from the
    end, so only their first piece may be short. A null or empty text is the end id alone; repeated rows
    are packed once each; a null id is carried as null; an empty table gives an empty result; other columns
    are ignored. The ids are those of byte_bpe_50k.json (a test compares the two libraries).
    """
    spark = df.sparkSession
    special = {"<|endoftext|>": 50256} if special is None else special
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(trimmed(_tokenise(ranks_path, pattern, special, capacity, end_id)), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(trimmed(_place(slots)), PLACED)
