import random
import re
from collections import Counter

import compare
import pytest

from quillspark.llm import collocations as op
from quillspark.llm import queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, share=50, top=2000):
    """From the definition, all counts in memory."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + z]) for z in range(1, longest + 1) for i in range(len(w) - z + 1))
    found = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    inside = Counter()
    for (lang, *w), c in found.items():
        for z in range(2, len(w)):
            for i in range(len(w) - z + 1):
                key = (lang, *w[i : i + z])
                inside[key] = max(inside[key], c)
    out = {}
    for (lang, *w), a in found.items():
        if 100 * inside[lang, *w] >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def made(df, **options):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in op.collocations(df, **options).collect())


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_random_texts_equal_brute_force(spark, longest):
    rng = random.Random(longest)
    words = ["the", "The", "THE", "new", "york", "City", "times", "é", "É", "a b", "x"]
    rows = [(rng.choice(["en", "en", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", ",", "\x0b", "!?"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "lang string, text string, n string, Score string").repartition(4)
    assert made(df, longest=longest, least=5, share=60, top=50) == brute(rows, longest, 5, 60, 50)


def test_small_holds_hand_on_early(spark, monkeypatch):
    """Pieces, steps and blocks of a few rows give the same counts."""
    rows = [("en", f"a b c. a b{'' if k % 3 else ' d'}\na b c, e f") for k in range(60)]
    want = brute(rows)
    for name, value in (("HELD_PIECES", 2), ("STEP_BYTES", 40), ("BLOCK_ROWS", 1)):
        monkeypatch.setattr(op, name, value)
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert made(table) == want
    held = list(op._gather(3, 3)(iter(op.pa.Table.from_pylist([{"lang": "en", "piece": "a b c", "m": 5}, {"lang": "en", "piece": "a b c", "m": 2}, {"lang": "de", "piece": "a", "m": 1}], op.PIECE).to_batches())))
    sums = Counter()
    for b in held:
        for lang, grams, m in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
            for r in op._unpacked(lang, grams, m).to_pylist():
                sums[r["lang"], r["gram"]] += r["m"]
    assert sums == {("en", "a"): 7, ("en", "b"): 7, ("en", "c"): 7, ("en", "a b"): 7, ("en", "b c"): 7, ("en", "a b c"): 7, ("en", ""): 21, ("de", "a"): 1, ("de", ""): 1}


def test_parts_that_very_many_ask_for(spark, monkeypatch):
    """Hot parts are broadcast, others meet by a shuffle; the rows are the same."""
    monkeypatch.setattr(op, "MOST_HOT", 3)
    rows = [("en", ". ".join(["w x"] * 10 + [f"w y{k} " + f"z{k} x"])) for k in range(20) for _ in range(10)]
    assert made(spark.createDataFrame(rows, "lang string, text string")) == brute(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_000, 4_000_000_000_001, 5_000_000_000_003
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    wide = lambda c: f"cast({c} as decimal(15,0))"
    score = row.selectExpr(f"(cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')}) as s").first()["s"]
    assert score == 1_000_000 * a * a // (left * right)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert made(odd, least=2) == brute(rows, least=2)
    assert made(nothing) == []


def test_query_equals_its_sql(spark, sf):
    assert compare.rows_of(queries.op13_collocations(spark, sf)) == compare.oracle_rows(compare.connect(sf), queries.ORACLES["op13_collocations"])
