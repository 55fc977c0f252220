import math
import random

import brute
import pytest

from quillspark.llm import ngram_join as op


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_matches_brute_force(spark, small, width, percent):
    rows = [(r[0], r[1]) for r in small.select("doc_id", "text").collect()]
    # Chains of small edits on a long and on short texts, so that links hang on one shingle.
    base = [f"w{i}" for i in range(120)]
    for k in range(40):
        base[(k * 3) % 120] = f"x{k}"
        rows.append((100_000 + k, " ".join(base)))
    for n in range(1, 30):
        rows.append((200_000 + n, " ".join(f"s{i}" for i in range(n))))
        rows.append((300_000 + n, " ".join(f"s{i}" for i in range(1, n))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.ngram_join(df, shingle=width, percent=percent).collect()}
    assert got == brute.components(rows, width, percent)


def test_large_group_of_near_copies(spark):
    """More sets than a chunk holds, linked through a few."""
    base = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(base))]
    for k in range(2 * op.CHUNK + 40):
        own = list(base)
        for j in range(1 + k % 4):
            own[(k * 7 + j * 19) % 80] = f"y{k}_{j}"
        rows.append((10 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.ngram_join(df).collect()}
    assert got == brute.components(rows, 4, 85)


def test_large_component_that_stays_apart(spark, monkeypatch):
    """Texts with one rare phrase in common and else of a choice of common phrases; only some have a copy to link with."""
    monkeypatch.setattr(op, "CHUNK", 16)
    rng, rows = random.Random(2), []
    for k in range(90):
        own = [f"r{j}" for j in range(12)]
        for p in sorted(rng.sample(range(12), rng.randint(4, 8))):
            own += [f"p{p}_{j}" for j in range(30)]
        rows.append((1000 - k, " ".join(own)))
        if k % 5 == 0:
            rows.append((2000 - k, " ".join(own[:-3])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.components(rows, 4, 85)
    assert 60 < len({c for _, c in want.values()}) < 100
    seen = []
    plain = op._in_full
    monkeypatch.setattr(op, "_in_full", lambda met, percent: seen.append(met.count()) or plain(met, percent))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.ngram_join(df).collect()} == want
    assert seen and seen[0] > 16
    for n in range(1, 400):
        for m in range(n, 100 * n // 85 + 1):
            assert 0 <= int(math.log(m) / math.log(100.001 / 85)) - int(math.log(n) / math.log(100.001 / 85)) <= 1


def test_light_sets_link_by_subsets(spark):
    """With the boundary held high, subsets link sets of unequal sizes, and the result is the same."""
    rows = [(k, " ".join(f"s{i}" for i in range(k % 20, k % 20 + 9 + k % 5))) for k in range(60)]
    rows += [(100 + n, " ".join(f"t{i}" for i in range(n))) for n in range(1, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.components(rows, 4, 85)
    for most in (0, 12, 24):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.ngram_join(df, most_light=most).collect()} == want
    rows_ = df.selectExpr("doc_id", "cast(null as long) row_key", "text")
    kept = op._kept_sets(rows_, op.staged(rows_.mapInArrow(op._sets(4, op.SEED), op.SETS), "sets"), 4, 85, op.SEED, 8)
    sure = op.candidate_edges(kept, 85, 24, 8).filter("sure")
    size = kept.select("cls", "n")
    unequal = sure.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b").filter("n_a <> n_b")
    assert sure.count() > 5 and unequal.count() > 5


def test_class_hashes_that_meet_are_told_apart(spark, monkeypatch):
    plain = op._class
    monkeypatch.setattr(op, "_class", lambda s, seed: None if not len(s) else 7 if seed == op.SEED else plain(s, seed))
    got = op.ngram_join(spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "A b c d")], "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_repeated_and_null_ids_lose_no_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "p"), (5, base + " tail", "q"), (5, "something else that stands alone here", "r"), (5, "yet another text of its own kind", "s"), (None, base + " end", "t"), (None, "only a null id has this text", "u"), (7, None, "v"), (7, "", "w"), (1, base, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__row` string").repartition(3)
    kept = op.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r["__row"] for r in kept.collect())
    assert got in (sorted("prsuvw"), sorted("xrsuvw"))


def test_odd_rows(spark, odd, nothing):
    rows = op.ngram_join(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[5] == (0, 5) and by[6] == (0, 6) and by[7] == (0, 7)
    assert by[1][1] == by[2][1] == by[3][1] == by[4][1] == 1 and by[8] == (1, 8) and by[9] == (1, 8)
    assert by[None][1] is None
    kept = op.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 5, 6, 7, 8, 10, 11}
    assert op.ngram_join(nothing).count() == 0 and op.keep_one_of_each(nothing).count() == 0


def test_subset_costs_choose_the_boundary():
    assert op.boundary({4: 1000}, 85) >= 4 and op.boundary({}, 85) == 0
    assert op.boundary({24: 1000, 400: 10}, 85) < 24
    for a in range(1, 40):
        for b in range(1, 40):
            c = op.least_overlap(a, b, 85)
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)


def test_the_shipped_number_of_ranges(spark, monkeypatch):
    """Other tests use fewer ranges for their small tables."""
    monkeypatch.setattr(op, "LEAST_RANGES", 64)
    rows = [(k, " ".join(f"w{(k // 3 * 50 + i) % 400}" for i in range(40 + k % 3))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op.ngram_join(df).collect()} == brute.components(rows, 4, 85)
