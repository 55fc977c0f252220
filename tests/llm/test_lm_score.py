import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import lm_score as op


def brute(docs, target_ids, frequent):
    """The definition, text by text: losses of each row without its own counts. ``frequent`` words have a prior of their own."""
    docs = [(d, (t or "").lower().split(), d in target_ids) for d, t in docs]

    def count(rows):
        word, history, pair = Counter(), Counter(), Counter()
        for _, ws, _ in rows:
            for a, b in zip([None, *ws], ws):
                word[b] += 1
                history[a] += 1
                pair[a, b] += 1
        return word, history, pair

    models = [count(docs), count([r for r in docs if r[2]])]
    tokens = [sum(m[0].values()) for m in models]
    scale = [tokens[1] / tokens[0] if tokens[1] else 1.0, 1.0]
    size = max(1, len(models[0][0]))
    rare = max(1, size - len(frequent))

    def loss(row, model, own):
        _, ws, inside = row
        (word, history, pair), s, out = models[model], scale[model], 0.0
        _, own_history, own_pair = own
        mine = 1 if model == 0 or inside else 0
        for a, b in zip([None, *ws], ws):
            mass = s * word[b] if b in frequent else s * (tokens[model] - sum(word[f] for f in frequent)) / rare
            p0 = (mass + op.WORD_PRIOR) / (s * tokens[model] + op.WORD_PRIOR * size)
            seen, heads = pair[a, b] - mine * own_pair[a, b], history[a] - mine * own_history[a]
            out -= math.log((s * seen + op.PAIR_PRIOR * p0) / (s * heads + op.PAIR_PRIOR))
        return out / len(ws)

    return sorted(((d, len(ws)) + ((loss(r, 1, count([r])), loss(r, 0, count([r]))) if ws else ()) for r in docs for d, ws, _ in [r]), key=str)


def close(got, want):
    got = sorted(((r["doc_id"], r["n_tokens"]) + ((r["target_loss"], r["background_loss"]) if r["n_tokens"] else ()) for r in got), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and len(a) == len(b) and np.allclose(a[2:], b[2:], rtol=1e-5)


@pytest.mark.parametrize("sample", [op.SAMPLE, 300])
def test_matches_brute_force(spark, odd, nothing, monkeypatch, sample):
    """Once with no frequent words, once with those of the few words that all texts share."""
    monkeypatch.setattr(op, "LEAST_RANGES", 8)
    monkeypatch.setattr(op, "SAMPLE", sample)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 10]
    if sample == 300:
        rows += [(100 + k, f"alpha beta w{k % 7} alpha beta w{k % 5} {'end' * (k % 2)}") for k in range(40)] + [(None, "alpha beta gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = [1, 3, 8, 104, 105, 109, 110]
    good = spark.createDataFrame([(i,) for i in [*ids, 1, None, 999]], "doc_id long")
    words, _ = op.frequent(df.selectExpr("0L as uid", "text"))
    named = {w for _, t in rows for w in (t or "").lower().split() if op._Words()[w.encode()] in set(words.tolist())}
    assert bool(named) == (sample == 300)
    close(op.cross_entropy_difference(df, good).collect(), brute(rows, set(ids), named))
    if sample == 300:
        close(op.cross_entropy_difference(df, good.limit(0)).collect(), brute(rows, set(), named))
        assert op.cross_entropy_difference(odd, good).count() == odd.count()
        assert op.cross_entropy_difference(nothing, good).count() == 0


def bordering():
    """3000 texts: words a0 to a29 are in 30 each, b0 to b29 in 29, every tenth text starts alike."""
    texts = [["x y"] if k % 10 == 0 else [] for k in range(3000)]
    for j in range(30):
        for k in range(30):
            texts[(j * 7 + k * 97) % 3000].append(f"a{j}")
            if k < 29:
                texts[(j * 11 + k * 89 + 5) % 3000].append(f"b{j}")
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_frequent_words_are_those_of_all_documents(spark, monkeypatch):
    """Words in exactly a hundredth of the documents have a prior of their own, those in one document less have none."""
    monkeypatch.setattr(op, "LEAST_RANGES", 8)
    rows = bordering()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    named = {"x", "y"} | {f"a{j}" for j in range(30)}
    words, pairs = op.frequent(df.selectExpr("doc_id as uid", "text"))
    key = lambda w: op._Words()[w.encode()]
    assert words.tolist() == sorted(key(w) for w in named)
    assert op.pair_keys(*(np.array([key(w)], dtype=np.uint64) for w in "xy"))[0] in pairs
    ids = set(range(0, 3000, 3))
    good = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    close(op.cross_entropy_difference(df, good).collect(), brute(rows, ids, named))


def test_numbers_of_texts_hold_with_little_room(monkeypatch):
    """Words are given out in part sums, bigrams are lowered; no word is lost, nor a bigram of a tenth of the texts."""
    monkeypatch.setattr(op, "HELD", 400)
    monkeypatch.setattr(op, "SLICE", 50)
    texts = [f"{t} rare{k}" for k, t in bordering()] + [None, "", " "]
    want, got, pairs = Counter(w for t in texts for w in set((t or "").split())), Counter(), set()
    parts = list(op._documents(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])))
    for kind, key, n in ((r["kind"], r["key"], r["n"]) for b in parts for r in b.to_pylist()):
        if kind == op.WORD:
            got[key] += n
        else:
            pairs.add(key)
    assert len(parts) > 3 and got == Counter({op._Words()[w.encode()]: n for w, n in want.items()})
    x, y = (np.array([op._Words()[w]], dtype=np.uint64) for w in (b"x", b"y"))
    assert int(op.pair_keys(x, y)[0]) in pairs and len(pairs) <= 400


def test_frequent_bigrams_are_the_same_in_any_tasks(spark):
    rows = [(k, f"{t} m{k % 97} n{k % 97}{' u v' * (k < 30)}{' s t' * (k < 29)}") for k, t in bordering()]
    texts = Counter(p for _, t in rows for ws in [t.split()] for p in set(zip([None, *ws], ws)))
    key = lambda w: op.START if w is None else np.uint64(op._Words()[w.encode()])
    want = sorted(int(op.pair_keys(*(np.array([key(w)], dtype=np.uint64) for w in p))[0]) for p, n in texts.items() if n >= 30)
    assert len(want) > 97
    for tasks in (1, 150):
        df = spark.createDataFrame(rows, "uid long, text string").selectExpr("*", "false as flag").repartition(tasks)
        often = op.frequent(df)
        counted = df.mapInArrow(op._count(spark.sparkContext.broadcast(often)), op.COUNTED)
        assert op._corpus(counted, *often)[0].hot_pairs.tolist() == want


def test_target_like_documents_score_lower(spark, small):
    english, other = small.filter("lang = 'en'"), small.filter("lang <> 'en'")
    scores = {r["doc_id"]: r["score"] for r in op.cross_entropy_difference(small, english.select("doc_id")).collect()}
    mean = lambda df: sum(x := [scores[r["doc_id"]] for r in df.collect() if scores[r["doc_id"]] is not None]) / len(x)
    assert mean(english) < mean(other) - 0.3


def test_the_sketch_counts_the_vocabulary():
    rng = np.random.default_rng(2)
    for size in (0, 1, 50, 3000, 40_000, 1_000_000):
        registers = np.zeros(1 << op.REGISTER_BITS, dtype=np.int64)
        for _ in range(2):
            op.sketch(registers, np.arange(size, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(5))
        assert abs(op.sketched(registers) - size) <= 0.03 * size
