"""N-gram Jaccard self-join by a size-aware heavy-light split, down to the classes of linked documents.

Documents with equal shingle sets form a class first; classes are what is joined. Small sets (light)
enumerate their fixed-size subsets: two sets of sizes a and b link exactly when they share a subset of
the overlap that a, b and the threshold call for, so a shared subset is a link. Large sets (heavy) put their
rarest shingles (as many as the threshold leaves room to miss, plus one) into inverted lists; scanning the
lists gives candidates, whose whole sets are then intersected. The boundary between light and heavy is
the one of least estimated cost over the histogram of set sizes.

* Shingles are counted exactly, by ranges of their hashes. A shingle of one class only can be in no overlap,
  so a class whose unshared shingles alone exceed what the threshold lets it miss is out at once; of the
  others only shared shingles travel on, rarest first.
* Very common shingles, found on a bounded sample, skip the counting: they are shared for certain, rank last,
  and go straight to their class, so that no range holds a third of all documents.
* A list of n classes gives n - 1 edges to its smallest class, never n * n pairs. Every true link lies inside
  a connected component of these candidate edges. A component that fits into one chunk is intersected at once.
* In a larger one each class first meets the head of one of its lists, chunk by chunk, which is linear. Where
  the links found so connect the whole component (as in a group of near copies) nothing is left to find out.
* Only components that stay apart meet in full: sets are dealt by size classes so wide that a set can only
  link into its own and the next, and chunks of these meet in pairs, each a product of 0/1 matrices. Pairs of chunks
  are numbered and dealt in turn, so that a large component is spread evenly.
* Classes are named by a 64-bit hash, held against a second one; should two sets ever share the first but
  not the second, the run starts over with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import counted_join, keyed, partitions, spread_join, staged, trimmed, without_keys
from quillspark.llm.components import connected_components
from quillspark.llm.passing import mixed

SHINGLE, PERCENT = 4, 85
#: Documents looked at (about) for very common shingles, and the share of them that has one.
SAMPLE, COMMON = 1000, 0.01
#: Frequencies from here on rank alike.
MOST_COUNTED = 255
#: The light side is at most this large; the cost model chooses within.
MOST_LIGHT = 24
#: Sets in a chunk.
CHUNK = 128
#: Seed of the class hash; the check hash has one of its own.
SEED, CHECK_SEED = 5, 1005
SETS = "doc_id long, row_key long, n long, cls long, chk long"
POSTED = "part int, cls binary, n binary, tok binary, level binary, who binary"
KEPT = "cls long, n long, tok binary"
EDGE = "a long, b long, sure boolean"
WORDS_KEPT = 1 << 17
#: Ranges of shingles, at least; more follow the shuffle partitions and the number of shingles. A class is named once in each range, so
#: the bytes a shingle costs rise with the ranges until each holds one shingle of a class.
LEAST_RANGES, SHINGLES_A_RANGE = 64, 4_000_000
#: Texts whose shingles are held at once.
SLICE = 400


class _Words(dict):
    """Hashes of words, kept between texts and dropped when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words give none."""
    w = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    size = min(width, len(w))
    acc = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        acc = mixed(acc + h[i : len(w) - size + 1 + i])
    return np.unique(acc)


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    """48-bit shingles."""
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _class(s: np.ndarray, seed: int) -> int | None:
    return int(xxhash.xxh64_intdigest(s.tobytes(), seed)) - (1 << 63) if len(s) else None


def _sets(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            found = [(len(s), _class(s, seed), _class(s, CHECK_SEED)) for s in (shingles(text.as_py() or "", width, words) for text in b.column(2))]
            cols = [b.column(0), b.column(1), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_key", "n", "cls", "chk"])

    return run


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, seen = _Words(), [], set()
        for b in batches:
            for text in b.column(0):
                s = shingles(text.as_py() or "", width, words)
                if (c := _class(s, SEED)) is not None and c not in seen:
                    seen.add(c)
                    held.append(np.unique(s >> np.uint64(16)))
        if held:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n)], names=["token", "n"])

    return run


def _posts(to: np.ndarray, cls: np.ndarray, n: np.ndarray, tok: np.ndarray, level: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each target: its classes with their sizes, and shingles with level and local class number."""
    order = np.argsort(to, kind="stable")
    to, tok, level, who = to[order], tok[order], level[order], who[order]
    values, at = np.unique(to, return_index=True)
    rows = []
    for value, t, v, w in zip(values, *(np.split(x, at[1:]) for x in (tok, level, who))):
        own, local = np.unique(w, return_inverse=True)
        rows.append((int(value), cls[own].astype("<i8").tobytes(), n[own].astype("<u4").tobytes(), _packed(t), v.astype(np.uint8).tobytes(), local.astype("<u4").tobytes()))
        if len(rows) == 500:
            yield _posted(rows)
            rows = []
    if rows:
        yield _posted(rows)


def _posted(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[x.split()[0] for x in POSTED.split(", ")])


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """cls, n, tok, level of every entry posted here."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for b in batches:
        for c, n, t, v, w in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
            who = np.frombuffer(w, dtype="<u4")
            for held, x in zip(out, (np.frombuffer(c, dtype="<i8")[who], np.frombuffer(n, dtype="<u4")[who], _unpacked(t), np.frombuffer(v, dtype=np.uint8))):
                held.append(x)
    kinds = (np.int64, np.uint32, np.uint64, np.uint8)
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=k) for x, k in zip(out, kinds))


def _home(cls: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed(cls.astype("<i8").view(np.uint64)) >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)


def _post_all(width: int, seed: int, common, ranges: int):
    """Shingles of each class to their range; very common ones straight to the home of their class.

    Targets below ``ranges`` count, those from ``ranges`` on are homes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, often = _Words(), set(), common.value
        for b in (part.slice(k, SLICE) for part in batches for k in range(0, part.num_rows, SLICE)):
            cls, n, tok = [], [], []
            for text in b.column(0):
                s = shingles(text.as_py() or "", width, words)
                c = _class(s, seed)
                if c is None or c in seen:
                    continue
                if len(seen) >= WORDS_KEPT:
                    seen.clear()
                seen.add(c)
                cls.append(c)
                tok.append(np.unique(s >> np.uint64(16)))
                n.append(len(tok[-1]))
            if not cls:
                continue
            cls, n, t = np.array(cls, dtype=np.int64), np.array(n), np.concatenate(tok)
            who = np.repeat(np.arange(len(cls)), n)
            to = ((mixed(t) >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)
            level = np.zeros(len(t), dtype=np.uint8)
            if len(often):
                hot = often[np.minimum(np.searchsorted(often, t), len(often) - 1)] == t
                to[hot] = ranges + _home(cls[who[hot]], ranges)
                level[hot] = MOST_COUNTED
            yield from _posts(to, cls, n, t, level, who)

    return run


def _count(ranges: int):
    """Shared shingles of a range go to the homes of their classes, with their number of classes as level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = []
        for b in batches:
            straight = np.array(b.column(0).to_pylist(), dtype=np.int64) >= ranges
            if straight.any():
                own = b.filter(pa.array(straight))
                yield own.set_column(0, "part", pa.array(np.array(own.column(0).to_pylist(), dtype=np.int32) - ranges))
            counted.append(b.filter(pa.array(~straight)))
        cls, n, tok, _ = _received(iter(counted))
        if not len(tok):
            return
        order = np.lexsort((cls, tok))
        cls, n, tok = cls[order], n[order], tok[order]
        new = np.r_[True, (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])]
        cls, n, tok = cls[new], n[new], tok[new]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        df = np.repeat(np.diff(np.r_[first, len(tok)]), np.diff(np.r_[first, len(tok)]))
        keep = df > 1
        if keep.any():
            cls, n, tok, level = cls[keep], n[keep], tok[keep], np.minimum(df[keep], MOST_COUNTED - 1)
            own, at, who = np.unique(cls, return_index=True, return_inverse=True)
            yield from _posts(_home(own, ranges)[who], own, n[at], tok, level, who)

    return run


def _gather(percent: int):
    """Classes that can have a link, with their shared shingles from the rarest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, n, tok, level = _received(batches)
        if not len(tok):
            return
        order = np.lexsort((tok, level, cls))
        cls, n, tok = cls[order], n[order], tok[order]
        new = np.r_[True, (cls[1:] != cls[:-1]) | (tok[1:] != tok[:-1])]
        cls, n, tok = cls[new], n[new], tok[new]
        first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        rows = []
        for a, z in zip(first, np.r_[first[1:], len(cls)]):
            size = int(n[a])
            if size - (z - a) < prefix_length(size, percent):
                rows.append((int(cls[a]), size, _packed(tok[a:z])))
        for k in range(0, len(rows), 2000):
            c = list(zip(*rows[k : k + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], names=["cls", "n", "tok"])

    return run


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least i with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def light_cost(n: int, percent: int) -> int:
    return sum(comb(n, c) for m in _partners(n, percent) if (c := least_overlap(n, m, percent)) <= min(n, m) and m)


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The largest light size: subsets to enumerate against list entries and fetched shingles, over all sizes.

    Sets up to the boundary that reach beyond it pay for both sides.
    """

    def heavy(n: int) -> float:
        return prefix_length(n, percent) + n / 4

    def total(most: int) -> float:
        return sum(k * ((light_cost(n, percent) if n <= most else 0) + (heavy(n) if 100 * n // percent > most else 0)) for n, k in histogram.items())

    return min(range(MOST_LIGHT + 1), key=lambda most: (total(most), most))


def _subset_signatures(tokens: np.ndarray, n: int, percent: int, most: int) -> list[int]:
    """Subsets of the shared shingles of a set of size n. Bit 63 marks light signatures, bit 62 those that want two different sizes."""
    out = []
    for m in _partners(n, percent):
        c = least_overlap(n, m, percent)
        if not m or m > most or c > min(n, m, len(tokens)):
            continue
        head = np.array([min(n, m), max(n, m)], dtype=np.uint64).tobytes()
        for chosen in combinations(tokens.tolist(), c):
            h = xxhash.xxh64_intdigest(head + np.array(chosen, dtype=np.uint64).tobytes())
            out.append((h >> 2) | 1 << 63 | (n != m) << 62)
    return out


def _signatures(percent: int, most: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, owner, sizes = [], [], b.column(1).to_pylist()
            for k, (n, blob) in enumerate(zip(sizes, b.column(2))):
                t = _unpacked(blob.as_py())
                if n <= most:
                    light = _subset_signatures(np.sort(t), n, percent, most)
                    sigs.append(np.array(light, dtype=np.uint64))
                    owner.append(np.full(len(light), k))
                if 100 * n // percent > most:
                    # Unshared shingles are the rarest: they fill the head of the prefix and find nothing.
                    head = t[: max(0, prefix_length(n, percent) - (n - len(t)))]
                    sigs.append(head)
                    owner.append(np.full(len(head), k))
            if not sigs:
                continue
            sig, who = np.concatenate(sigs), np.concatenate(owner).astype(np.int64)
            cls, size = b.column(0).to_numpy(), np.array(sizes, dtype=np.uint32)
            if not len(sig):
                continue
            to = (mixed(sig) >> np.uint64(33)) % np.uint64(ranges)
            order = np.argsort(to, kind="stable")
            sig, who, to = sig[order], who[order], to[order]
            values, at = np.unique(to, return_index=True)
            rows = []
            for value, s, w in zip(values, np.split(sig, at[1:]), np.split(who, at[1:])):
                own, local = np.unique(w, return_inverse=True)
                rows.append((int(value), cls[own].astype("<i8").tobytes(), size[own].tobytes(), s.astype("<u8").tobytes(), local.astype("<u4").tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "cls", "size", "sig", "who"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of one range of signatures: an edge from the smallest class of a list to each other."""
    cls, size, sig = [], [], []
    for b in batches:
        for c, z, s, w in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
            who = np.frombuffer(w, dtype="<u4")
            cls.append(np.frombuffer(c, dtype="<i8")[who])
            size.append(np.frombuffer(z, dtype="<u4")[who])
            sig.append(np.frombuffer(s, dtype="<u8"))
    if not sig:
        return
    cls, size, sig = np.concatenate(cls), np.concatenate(size), np.concatenate(sig)
    order = np.argsort(sig, kind="stable")
    cls, size, sig = cls[order], size[order], sig[order]
    new = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    lens = np.diff(np.r_[new, len(sig)])
    least = np.repeat(np.minimum.reduceat(cls, new), lens)
    mixed = np.repeat(np.minimum.reduceat(size, new) < np.maximum.reduceat(size, new), lens)
    light, differ = sig >> np.uint64(63) == 1, (sig >> np.uint64(62)) & np.uint64(1) == 1
    keep = (cls != least) & (~light | ~differ | mixed)
    edges = np.unique(np.stack([least[keep], cls[keep], light[keep].astype(np.int64)], axis=1), axis=0)
    for k in range(0, len(edges), 100_000):
        e = edges[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy()), pa.array(e[:, 2] == 1)], names=["a", "b", "sure"])


def links(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of linked sets, from products of 0/1 matrices over blocks of shared shingles.

    ``sets`` hold at least the shingles that two of them share; ``sizes`` count all.
    """
    m = len(sets)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = counts[ids] > 1
    column = (np.cumsum(counts > 1) - 1)[ids[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), dtype=np.float64)
    width = max(256, (1 << 22) // max(m, 1))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        x = np.zeros((m, min(width, int(column[hi - 1]) - start + 1)), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    found = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(found, False)
    return found


def _forest(found: np.ndarray, cls: list[int]) -> list[tuple[int, int]]:
    left, edges = set(range(len(cls))), []
    while left:
        queue = [left.pop()]
        while queue:
            u = queue.pop()
            for v in np.flatnonzero(found[u]).tolist():
                if v in left:
                    left.remove(v)
                    queue.append(v)
                    edges.append((cls[u], cls[v]))
    return edges


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls, sets, sizes = None, [], [], []

        def done() -> list[tuple[int, int]]:
            return _forest(links(sets, np.array(sizes), percent), cls) if len(cls) > 1 else []

        for b in batches:
            out = []
            for root, pair, c, n, tok in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                if (root, pair) != key:
                    out += done()
                    key, cls, sets, sizes = (root, pair), [], [], []
                cls.append(c)
                sets.append(_unpacked(tok))
                sizes.append(n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return run


def _compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Edges of spanning forests of the links inside each group (root, pair) of ``dealt`` (root, pair, cls, n, tok)."""
    parts = partitions(dealt.sparkSession)
    part = F.pmod(F.xxhash64("root") + F.col("pair"), F.lit(parts)).cast("int")
    dealt = dealt.select(part.alias("part"), "root", "pair", "cls", "n", "tok").repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("root", "pair").mapInArrow(trimmed(_verify(percent)), "a long, b long")


def _with_heads(sets: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Links among the classes that share a list head, chunk by chunk; the head is in each of its chunks."""
    led = candidates.groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("root"))
    chunks = led.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / (CHUNK - 1)).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("cls", F.lit(11)), F.col("k")).cast("long")
    members = spread_join(sets.join(led, "cls"), chunks, "root", "cls").select("root", own.alias("pair"), "cls", "n", "tok")
    heads = sets.join(chunks, F.col("cls") == F.col("root")).select("root", F.explode(F.expr("sequence(0L, k - 1L)")).alias("pair"), "cls", "n", "tok")
    return _compared(members.unionByName(heads), percent)


def size_class(n: Column, percent: int) -> Column:
    """Sets that link lie in the same size class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.001 / percent))).cast("int")


def _in_full(met: DataFrame, percent: int) -> DataFrame:
    """Links inside each component of ``met`` (root, cls, n, tok): chunks of one size class or of neighbouring ones meet."""
    met = met.withColumn("b", size_class(F.col("n"), percent))
    by = met.groupBy("root", "b").agg(F.ceil(F.count(F.lit(1)) / (CHUNK // 2)).cast("long").alias("k"))
    order = W.partitionBy("root").orderBy("b")  # at most some hundred size classes a component
    after = F.when(F.lead("b").over(order) == F.col("b") + 1, F.lead("k").over(order)).otherwise(F.lit(0).cast("long"))
    before = F.when(F.lag("b").over(order) == F.col("b") - 1, F.lag("k").over(order)).otherwise(F.lit(0).cast("long"))
    by = by.select("root", "b", "k", after.alias("after"), before.alias("before"))
    # Numbers of a size class: pairs of its chunks, pairs with the next class, a lone chunk with itself.
    by = by.withColumn("used", F.expr("k * (k - 1) div 2 + k * after + 1"))
    by = by.withColumn("first", F.sum("used").over(order) - F.col("used")).withColumn("first_before", F.lag("first").over(order))
    met = met.withColumn("__group", F.struct("root", "b"))
    by = by.withColumn("__group", F.struct("root", "b")).drop("root", "b")
    dealt = spread_join(met, by, "__group", "cls").withColumn("c", F.pmod(F.xxhash64("cls", F.lit(11)), F.col("k")).cast("long"))
    pairs = F.concat(
        F.expr("transform(filter(sequence(0L, k - 1), x -> x <> c), x -> first + greatest(x, c) * (greatest(x, c) - 1) div 2 + least(x, c))"),
        F.expr("if(k = 1, array(first + after), array())"),
        F.expr("if(after > 0, transform(sequence(0L, after - 1), x -> first + k * (k - 1) div 2 + c * after + x), array())"),
        F.expr("if(before > 0, transform(sequence(0L, before - 1), x -> first_before + before * (before - 1) div 2 + x * k + c), array())"),
    )
    return _compared(dealt.select("root", F.explode(pairs).alias("pair"), "cls", "n", "tok"), percent)


def _verified(sets: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Edges that connect exactly what the true links inside the candidate components connect."""
    parts = staged(connected_components(candidates), "candidates")
    size = parts.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    roots = staged(size.filter(F.col("m") > CHUNK).select("root"), "large")
    small = spread_join(parts, roots, "root", "v", "left_anti")
    met = sets.join(small, F.col("cls") == F.col("v")).select("root", F.lit(0).cast("long").alias("pair"), "cls", "n", "tok")
    found = _compared(met, percent)
    if roots.isEmpty():
        return found
    large = spread_join(parts, roots, "root", "v", "left_semi").select("v", "root")
    led = staged(_with_heads(sets, candidates.join(large, F.col("b") == F.col("v"), "left_semi"), percent), "led")
    joined = connected_components(led).select("v", F.col("root").alias("own"))
    state = large.join(joined, "v", "left").select("v", "root", F.coalesce("own", "v").alias("own"))
    apart = state.groupBy("root").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x <> y").select("root")
    open_ = spread_join(state, apart, "root", "v", "left_semi")
    met = sets.join(open_, F.col("cls") == F.col("v")).select("root", "cls", "n", "tok")
    return found.unionByName(led).unionByName(_in_full(met, percent))


def candidate_edges(kept: DataFrame, percent: int, most: int, ranges: int) -> DataFrame:
    """a, b, sure: from each list its smallest class to the others. Lists of light signatures (sets up to ``most``) are links for sure."""
    signed = kept.mapInArrow(trimmed(_signatures(percent, most, ranges)), "part int, cls binary, size binary, sig binary, who binary")
    return staged(signed.repartitionById(ranges, F.col("part")).mapInArrow(trimmed(_scan), EDGE), "links")


def _kept_sets(rows: DataFrame, sets: DataFrame, shingle: int, percent: int, seed: int, ranges: int) -> DataFrame:
    """The classes that can have a link, with size and shared shingles, rarest first."""
    every = max(1, sets.count() // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(every)) == 0).select("text")
    often = sample.mapInArrow(trimmed(_sampled(shingle)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") >= max(8, int(COMMON * SAMPLE))).select("token").toArrow().column(0).to_numpy()
    common = rows.sparkSession.sparkContext.broadcast(np.sort(often.astype(np.uint64)))
    posted = rows.select("text").mapInArrow(trimmed(_post_all(shingle, seed, common, ranges)), POSTED)
    shared = posted.repartitionById(ranges, F.col("part") % ranges).mapInArrow(trimmed(_count(ranges)), POSTED)
    return staged(shared.repartitionById(ranges, F.col("part")).mapInArrow(trimmed(_gather(percent)), KEPT), "kept")


def _joined(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, key: Column, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row_key, n, cls), and the classes with their root: cls, root."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key.alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for seed in range(SEED, SEED + 20):
        sets = staged(rows.mapInArrow(trimmed(_sets(shingle, seed)), SETS), "sets")
        if sets.filter("cls is not null").groupBy("cls").agg(F.min("chk").alias("x"), F.max("chk").alias("y")).filter("x <> y").isEmpty():
            break
    # A task holds a range whole, so ranges grow with the shingles.
    ranges = max(LEAST_RANGES, partitions(spark), (sets.agg(F.sum("n")).first()[0] or 0) // SHINGLES_A_RANGE)
    kept = _kept_sets(rows, sets, shingle, percent, seed, ranges)
    if most is None:
        small = F.least("n", F.lit(2 * MOST_LIGHT))
        most = boundary({r["size"]: r["count"] for r in kept.groupBy(small.alias("size")).count().collect()}, percent)
    edges = candidate_edges(kept, percent, most, ranges)
    sure = edges.filter("sure").select("a", "b")
    linked = connected_components(sure.unionByName(_verified(kept, edges.filter("not sure").select("a", "b"), percent)))
    classes = sets.filter("cls is not null").select("cls").distinct()
    return sets, classes.join(linked, F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("root", "cls").alias("root"))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, most_light: int | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Words are runs of other than ASCII white space, A-Z lowered; a text of fewer than ``shingle`` words is
    one shingle. A null, empty or blank text has no shingles and is its own component. Equal sets link;
    rows with a null id take part and never name a component that has another id; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored. ``most_light`` sets the
    largest light set in place of the cost model, which changes the way only.
    """
    sets, roots = _joined(df, id_col, text_col, shingle, percent, F.lit(None).cast("long"), most_light)
    named = sets.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("alike"))
    named = staged(named.join(roots, "cls"), "named")
    least = staged(named.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("m")), "least")
    # A class and a component may hold a third of all rows.
    named = staged(counted_join(named, least, ["root"], "cls", "m").select("cls", "component", "alike"), "components")
    out = counted_join(sets.select("doc_id", "n", "cls"), named, ["cls"], "doc_id", "alike", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The row of smallest id of each component, with all columns of ``df``, whatever their names.

    Rows are told apart by a key of their own: of rows that share the smallest id one stays (which, a hash of their
    shingles decides), and a repeated id costs no other text its row. Null ids come last. Rows without words (null, empty or blank texts) link with nothing
    and all stay. An empty table gives an empty result.
    """
    table, key = keyed(df, id_col)
    sets, roots = _joined(table, id_col, text_col, shingle, percent, F.col(key), None)
    sets = sets.filter("cls is not null").select("cls", "row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "cls", "row_key").alias("place"))
    first = sets.groupBy("cls").agg(F.min("place").alias("first")).join(roots, "cls")
    stays = first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("row_key"))
    return without_keys(table, key, sets.select("row_key").join(stays, "row_key", "left_anti"), df.columns)
