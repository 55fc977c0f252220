"""Cross-entropy difference: how much more a target corpus resembles a document than the background does.

Two bigram models, of the target documents and of all documents, share one vocabulary. Each model gives

    p(w | v) = (s c(v, w) + M p0(w)) / (s c(v) + M),   p0(w) = (s c(w) + U) / (s N + U V)

with exact counts c, N tokens and about V words. The models are matched: the background's counts are scaled (s) to the target's number of
tokens, so that the same smoothing weighs alike in both. p0 takes frequent words by their own count; the rest of the words
share what is left alike. A document is scored without its own counts, by either model. Each token loses -log p;
the score of a document is the mean over its tokens of target loss minus background loss (low: target-like).

The counts grow with the corpus and are never gathered: documents send their bigrams and histories to ranges of
hashes, a range counts its own exactly and returns to each document what these cost it. As -log p is a sum of a bigram's
part and a history's part, nothing else has to meet. Frequent words and bigrams, those that a hundredth of all documents
has, follow from exact numbers of documents. They are counted in one pass and then scored where the document is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import keyed, partitions, staged, trimmed
from quillspark.llm.passing import Passing, mixed

#: Weight of p0 in the bigram model (M), and of each word in p0 (U).
PAIR_PRIOR, WORD_PRIOR = 2.0, 0.5
#: A frequent word or bigram is in one of COMMON documents, and in LEAST; a table of fewer than SAMPLE documents counts as one of so many.
SAMPLE, COMMON, LEAST = 1000, 100, 8
#: Sums by word or bigram that a task gathers before it adds them up.
HELD = 1 << 21
#: Ranges at least; more follow the shuffle partitions and the number of tokens.
LEAST_RANGES, TOKENS_A_RANGE = 64, 2_000_000
#: Texts whose words are held at once, and the words that keep their hash.
SLICE, WORDS_HELD = 500, 1 << 20
#: Bigrams and histories travel as 48-bit keys, of which histories have the top bit set.
KEY_BITS = np.uint64(47)
TOP = np.uint64(1) << KEY_BITS
#: The history of a text's first word.
START = np.uint64(0x5157)
#: Registers (a power of two) of the sketch that counts the vocabulary, within about one per cent.
REGISTER_BITS = 14
WORD, HISTORY, PAIR, TOTAL, TEXTS, REGISTER = range(6)
COUNTED = "kind int, key long, n_all long, n_target long"
POSTED = "part int, uid binary, flag binary, per binary, key binary, k binary, prior binary"
SUMS = "part int, uid binary, n binary, target binary, background binary"
SCORED = "uid long, n_tokens long, target_loss double, background_loss double, score double"


class _Words(dict):
    """Hashes of words, kept between texts and dropped when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


def tokens(texts: list[str | None], words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) of all words (lower-case runs of other than white space), and the number of words of each text."""
    split = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    return np.fromiter((words[w] for own in split for w in own), dtype=np.uint64, count=int(n.sum())), n


def histories(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The word before each token; START at the head of a text."""
    prev = np.concatenate([[START], ids[:-1]]).astype(np.uint64) if len(ids) else ids
    prev[(np.cumsum(n) - n)[n > 0]] = START
    return prev


def pair_keys(prev: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed(mixed(prev) + ids) >> np.uint64(64 - 47)


def _place(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index in the sorted ``among`` from 1, or 0."""
    if not len(among):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at + 1, 0)


def _distinct(who: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """who, key (48 bits), number and one position of each distinct (who, key), by who."""
    both = (who.astype(np.uint64) << np.uint64(48)) | keys
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, dtype=np.int64)
    return (both[first] >> np.uint64(48)).astype(np.int64), both[first] & np.uint64((1 << 48) - 1), np.diff(np.r_[first, len(both)]), order[first]


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def sketch(registers: np.ndarray, ids: np.ndarray) -> None:
    """Note words in the registers: the longest run of leading zeros of the hashes of each."""
    h = mixed(ids + np.uint64(9))
    zeros = 51 - np.frexp((h & np.uint64((1 << 50) - 1)).astype(np.float64))[1]
    np.maximum.at(registers, (h >> np.uint64(64 - REGISTER_BITS)).astype(np.int64), zeros)


def sketched(registers: np.ndarray) -> int:
    """About how many distinct words the registers have seen; few are counted by the empty registers."""
    m = len(registers)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -registers.astype(float))
    empty = int((registers == 0).sum())
    return round(m * np.log(m / empty)) if empty and raw <= 2.5 * m else round(raw)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)


def _texts(who: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and in how many texts each is; ``who``, the text of each key, ascends."""
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    own = new | np.r_[True, who[1:] != who[:-1]][: len(keys)]
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.r_[0, np.cumsum(own)][np.r_[first, len(keys)]])


class _Tally:
    """Sums by key. What is gathered is added up when ``full``."""

    def __init__(self) -> None:
        self.parts, self.size, self.lost = [], 0, 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.size += len(key)

    def full(self) -> bool:
        """Whether the sums take half of the room even when added up."""
        return self.size >= HELD and len(self.sums()[0]) > HELD // 2

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            key, n = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            self.parts = [(key[first], np.diff(np.r_[0, np.cumsum(n)][np.r_[first, len(key)]]))]
            self.size = len(first)
        return self.parts[0]

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.sums()
        self.parts, self.size = [], 0
        return out

    def lower(self) -> None:
        """Take as much from all sums as leaves a quarter of the room in use: large ones stay, too low by ``lost`` at most (Misra and Gries)."""
        key, n = self.taken()
        cut = np.partition(n, -HELD // 4 - 1)[-HELD // 4 - 1]
        self.lost += cut
        self.add(key[n > cut], n[n > cut] - cut)


def is_frequent(texts, documents):
    """Whether what is in so many texts is frequent; of numbers, arrays and columns."""
    return (texts >= LEAST) & (texts * COMMON >= documents) & (texts * COMMON >= SAMPLE)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each word is, exact when summed, and bigrams half as common in the task's texts as a frequent one (at most so many texts)."""
    words, of_words, of_pairs, texts = _Words(), _Tally(), _Tally(), 0

    def table(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for b in _slices(batches):
        ids, n = tokens(b.column("text").to_pylist(), words)
        who = np.repeat(np.arange(len(n)), n)
        texts += len(n)
        of_words.add(*_texts(who, ids))
        if of_words.full():
            yield table(WORD, *of_words.taken())
        of_pairs.add(*_texts(who, pair_keys(histories(ids, n), ids)))
        if of_pairs.full():
            of_pairs.lower()
    yield table(WORD, *of_words.taken())
    key, n = of_pairs.taken()
    n = n + of_pairs.lost
    many = n * 2 * COMMON >= texts
    yield table(PAIR, key[many], n[many])


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent words, and bigrams that may be: no more than a hundredth, or half of it, of the documents has places for them.

    A frequent bigram loses less than half of its texts to tasks that don't name it; which ones are frequent is told by ``_corpus``.
    """
    documents = rows.count()
    found = rows.select("text").mapInArrow(trimmed(_documents), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = found.filter(is_frequent(F.col("n") * F.when(F.col("kind") == PAIR, 2).otherwise(1), documents)).toArrow()
    kind, key = found.column("kind").to_numpy(), found.column("key").to_numpy().astype(np.uint64)
    return tuple(np.sort(key[kind == k]) for k in (WORD, PAIR))


def _count(often):
    """Counts of frequent words, histories and bigrams, of tokens and texts, texts of bigrams and all, and the registers of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (hot_words, hot_pairs) = _Words(), often.value
        total = [np.zeros((2, size + 1), dtype=np.int64) for size in (len(hot_words), len(hot_words), len(hot_pairs), 1, len(hot_pairs))]
        registers = np.zeros(1 << REGISTER_BITS, dtype=np.int64)

        def table(kind: int, key: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key), pa.array(counts[0]), pa.array(counts[1])], names=["kind", "key", "n_all", "n_target"])

        for b in _slices(batches):
            ids, n = tokens(b.column("text").to_pylist(), words)
            own = b.column("flag").to_numpy(zero_copy_only=False)
            flag, prev = np.repeat(own, n), histories(ids, n)
            pairs = _place(pair_keys(prev, ids), hot_pairs)
            for t, at in zip(total, (_place(ids, hot_words), _place(prev, hot_words), pairs)):
                for row, where in ((0, at), (1, at[flag])):
                    t[row] += np.bincount(where, minlength=t.shape[1])
            at, texts = _texts(np.repeat(np.arange(len(n)), n)[pairs > 0], pairs[pairs > 0])
            total[TEXTS][0, at] += texts
            total[TEXTS][0, 0] += len(n)
            total[TOTAL] += np.array([[len(ids), (n > 0).sum()], [flag.sum(), (n[own] > 0).sum()]])
            sketch(registers, ids)
        yield table(REGISTER, np.arange(len(registers)), np.array([registers, registers]))
        for kind, t in enumerate(total):
            yield table(kind, np.arange(t.shape[1]), t)

    return run


@dataclass
class Corpus:
    """What scoring has to know beside the counts of the ranges. Rows 0 and 1 of arrays are background and target."""

    hot_words: np.ndarray
    hot_pairs: np.ndarray
    scale: np.ndarray  # of either model's counts
    prior: np.ndarray  # M p0 of frequent words from index 1 on, of all others at 0
    history: np.ndarray  # counts of frequent histories from index 1 on, of START at 0
    pair: np.ndarray  # counts of frequent bigrams from index 1 on


def losses(model: int, corpus: Corpus, own: np.ndarray, count: np.ndarray, flag: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
    """What ``own`` occurrences cost, of bigrams, or of histories if ``prior`` is None; the document's own ones don't count."""
    others = corpus.scale[model] * (count - (own if model == 0 else own * flag))
    return -own * np.log(others + corpus.prior[model][prior]) if prior is not None else own * np.log(others + PAIR_PRIOR)


def _post(held, ranges: int):
    """Rare bigrams and histories to their ranges; what frequent ones cost straight to the home of the document (parts from ``ranges`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, corpus = _Words(), held.value
        for b in _slices(batches):
            uid, own = b.column("uid").to_numpy(), b.column("flag").to_numpy(zero_copy_only=False)
            ids, n = tokens(b.column("text").to_pylist(), words)
            who, prev = np.repeat(np.arange(len(n)), n), histories(ids, n)
            local = np.zeros((2, len(n)))
            rare = []
            for is_pair, keys, among in ((True, pair_keys(prev, ids), corpus.hot_pairs), (False, prev, corpus.hot_words)):
                w, key, k, at = _distinct(who, keys if is_pair else keys & (TOP - np.uint64(1)) | TOP)
                prior = _place(ids[at], corpus.hot_words) if is_pair else None
                place = _place(keys[at], among)
                hot = place > 0 if is_pair else (place > 0) | (keys[at] == START)
                counts = corpus.pair if is_pair else corpus.history
                for model in (0, 1):
                    cost = losses(model, corpus, k[hot], counts[model][place[hot]], own[w[hot]], prior[hot] if is_pair else None)
                    local[model] += np.bincount(w[hot], cost, minlength=len(n))
                rare.append((w[~hot], key[~hot], k[~hot], prior[~hot] if is_pair else np.zeros((~hot).sum(), dtype=np.int64)))
            w, key, k, prior = (np.concatenate(x) for x in zip(*rare))
            to = (mixed(key) >> np.uint64(33)) % np.uint64(ranges)
            order = np.lexsort((w, to))
            values, at = np.unique(to[order], return_index=True)
            rows = []
            for value, i in zip(values.tolist(), np.split(order, at[1:])):
                docs, per = np.unique(w[i], return_counts=True)
                rows.append((value, uid[docs].astype("<i8"), own[docs].astype("u1"), per.astype("<u4"), packed(key[i]), k[i].astype("<u4"), prior[i].astype("<u4")))
            homes = _home(uid, ranges)
            for home in np.unique(homes).tolist():
                i = np.flatnonzero(homes == home)
                rows.append((ranges + home, uid[i].astype("<i8"), b"", n[i].astype("<i8"), b"", local[1, i].astype("<f4"), local[0, i].astype("<f4")))
            yield _blobs(rows, POSTED)

    return run


def _home(uid: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed(uid.astype("<i8").view(np.uint64) + np.uint64(77)) >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)


def _blobs(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    blob = lambda x: x if isinstance(x, bytes) else x.tobytes()
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(list(map(blob, c)), pa.binary()) for c in cols[1:])], names=names)


def _range(held, ranges: int):
    """Exact counts of one range, and what they cost each document, to its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, parts, size = held.value, [], 0
        for b in batches:
            direct = []
            for part, uid, flag, per, key, k, prior in zip(*(c.to_pylist() for c in b.columns)):
                if part >= ranges:
                    direct.append((part - ranges, uid, per, k, prior))
                    continue
                docs, per = np.frombuffer(uid, dtype="<i8"), np.frombuffer(per, dtype="<u4")
                parts.append((docs, np.frombuffer(flag, dtype="u1"), np.repeat(np.arange(size, size + len(docs)), per), unpacked(key), np.frombuffer(k, dtype="<u4"), np.frombuffer(prior, dtype="<u4")))
                size += len(docs)
            yield _blobs(direct, SUMS)
        if not parts:
            return
        docs, flag, who, key, k, prior = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(key)
        who, key, k, prior = who[order], key[order], k[order].astype(np.int64), prior[order]
        flag = flag[who]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        width = np.diff(np.r_[first, len(key)])
        is_pair = key < TOP
        sums = []
        for model in (1, 0):
            count = np.repeat(np.add.reduceat(k if model == 0 else k * flag, first), width)
            cost = np.where(is_pair, losses(model, corpus, k, count, flag, prior), losses(model, corpus, k, count, flag, None))
            sums.append(np.bincount(who, cost, minlength=len(docs)).astype("<f4"))
        homes = _home(docs, ranges)
        order = np.argsort(homes, kind="stable")
        values, at = np.unique(homes[order], return_index=True)
        yield _blobs([(v, docs[i].astype("<i8"), b"", sums[0][i], sums[1][i]) for v, i in zip(values.tolist(), np.split(order, at[1:]))], SUMS)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uids, n, costs = [], [], []
    for b in batches:
        for uid, own, t, g in zip(*(c.to_pylist() for c in b.columns[1:])):
            uids.append(np.frombuffer(uid, dtype="<i8"))
            n.append(np.frombuffer(own, dtype="<i8") if own else np.zeros(len(uids[-1]), dtype=np.int64))
            costs.append(np.array([np.frombuffer(t, dtype="<f4"), np.frombuffer(g, dtype="<f4")], dtype=float))
    if not uids:
        return
    docs, who = np.unique(np.concatenate(uids), return_inverse=True)
    cost = np.concatenate(costs, axis=1)
    size = np.zeros(len(docs), dtype=np.int64)
    np.add.at(size, who, np.concatenate(n))
    t, g = (np.bincount(who, c, minlength=len(docs)) / np.maximum(size, 1) for c in cost)
    cols = [pa.array(x, mask=size == 0) for x in (t, g, t - g)]
    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(size), *cols], names=[x.split()[0] for x in SCORED.split(", ")])


def _flagged(table: DataFrame, key: str, id_col: str, text_col: str, target: DataFrame) -> DataFrame:
    """uid, text, flag. Only rows that a filter of bounded size lets pass are shuffled to meet the target's ids."""
    ident = F.col(f"`{id_col}`").cast("long")
    rows = table.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNotNull().alias("known"), F.col(key).alias("uid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    passing = Passing(target)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = passing(b.column(0).to_numpy()) & b.column(1).to_numpy(zero_copy_only=False)
            yield b.append_column("may", pa.array(may))

    probed = rows.mapInArrow(trimmed(probe), "id long, known boolean, uid long, text string, may boolean")
    met = probed.filter("may").join(target.withColumn("flag", F.lit(True)).hint("merge"), "id", "left")
    met = met.select("uid", "text", F.coalesce("flag", F.lit(False)).alias("flag"))
    return met.unionByName(probed.filter("not may").select("uid", "text", F.lit(False).alias("flag")))


def _corpus(counted: DataFrame, hot_words: np.ndarray, hot_pairs: np.ndarray) -> tuple[Corpus, int]:
    """The model's shared part, and the number of tokens."""
    registers = np.zeros(1 << REGISTER_BITS, dtype=np.int64)
    counts = [np.zeros((2, size + 1)) for size in (len(hot_words), len(hot_words), len(hot_pairs), 1, len(hot_pairs))]
    for r in counted.groupBy("kind", "key").agg(F.sum("n_all").alias("a"), F.sum("n_target").alias("t"), F.max("n_all").alias("most")).collect():
        if r["kind"] == REGISTER:
            registers[r["key"]] = r["most"]
        else:
            counts[r["kind"]][:, r["key"]] = r["a"], r["t"]
    vocabulary = sketched(registers)
    word, history, pair, total, texts = counts
    keep = is_frequent(texts[0], texts[0, 0])
    hot_pairs, pair = hot_pairs[keep[1:]], pair[:, np.r_[True, keep[1:]]]
    n_tokens = total[:, 0]
    scale = np.array([n_tokens[1] / n_tokens[0] if n_tokens[1] else 1.0, 1.0])
    rare = max(1, vocabulary - len(hot_words))
    prior = scale[:, None] * word + WORD_PRIOR
    prior[:, 0] = scale * (n_tokens - word[:, 1:].sum(axis=1)) / rare + WORD_PRIOR
    prior *= PAIR_PRIOR / (scale * n_tokens + WORD_PRIOR * max(1, vocabulary))[:, None]
    history[:, 0] = total[:, 1]  # texts, each with one START
    return Corpus(hot_words, hot_pairs, scale, prior, history, pair), int(n_tokens[0])


def cross_entropy_difference(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, target_loss, background_loss, score.

    ``target_ids`` (one column) names the target documents; all rows of such an id are of the target. A null,
    empty or blank text has no tokens and null losses. Rows that repeat are documents of their own, each scored with the
    counts of the others. Rows with a null id are of the background. With an empty target the score compares the
    background with the bare prior; an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    table, key = keyed(df, id_col)
    target = target_ids.toDF("id").select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct()
    rows = _flagged(table, key, id_col, text_col, staged(target, "target"))
    often = frequent(table.select(F.col(key).alias("uid"), F.col(f"`{text_col}`").cast("string").alias("text")))
    hot = spark.sparkContext.broadcast(often)
    counted = staged(rows.mapInArrow(trimmed(_count(hot)), COUNTED), "counts")
    corpus, n_tokens = _corpus(counted, *often)
    held = spark.sparkContext.broadcast(corpus)
    ranges = max(LEAST_RANGES, partitions(spark), n_tokens // TOKENS_A_RANGE)
    posted = rows.mapInArrow(trimmed(_post(held, ranges)), POSTED).repartitionById(ranges, F.col("part") % ranges)
    sums = posted.mapInArrow(trimmed(_range(held, ranges)), SUMS).repartitionById(ranges, F.col("part"))
    scored = sums.mapInArrow(trimmed(_total), SCORED)
    names = table.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(key).alias("uid"))
    return names.join(scored, "uid").drop("uid")
