import re
import sys
from collections import Counter

import brute
import corpus_pipeline
import test_packing
from test_mixing import draw, poisson_count

from quillspark.llm import mixing


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    text = lambda ids: [(d, rows[d]["text"]) for d in ids]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        out = stage(spark, out, sf).cache()
        assert out.columns == docs.columns
        after = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "language_id":
            assert set(before) - set(after) == set()  # every given document has a language
        elif name == "exact_dedup":
            assert set(after) == {keep for _, keep, _, _ in brute.dedup(text(before))}
        elif name == "ngram_join":
            assert set(after) == {c for _, c in brute.components(text(before), 5, 80).values()}
        else:
            volume = Counter()
            for d in before:
                volume[rows[d]["source"]] += len(rows[d]["text"])
            aim = {s: v**mixing.EXPONENT for s, v in volume.items()}
            rate = {s: aim[s] / sum(aim.values()) * sum(volume.values()) / volume[s] for s in volume}
            want = Counter({d: n for d in before if (n := poisson_count(draw(mixing.SEED, d), rate[rows[d]["source"]]))})
            assert after == want
    used, least = test_packing.check(out, corpus_pipeline.STAGES[-1][1](spark, out, sf))
    assert used <= least * 1.1 + 1  # few pieces, many of them over half a sequence


def plain_dedup(rows):
    """Rows (id, text, ..., tag): of equal texts the longest, then the smallest id; equal rows are interchangeable."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(brute.BLANK, "", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def near_groups(rows):
    """The components as lists of rows; rows without words are alone."""
    by, groups = brute.components([(k, r[1]) for k, r in enumerate(rows)], 5, 80), {}
    for k, r in enumerate(rows):
        groups.setdefault(by[k][1], []).append(r)
    return list(groups.values())


def odd_corpus(spark, sf):
    """Given texts with repeated and null ids, null, blank and letterless texts, copies, and columns with names of our own."""
    given = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = list(given)
    for k in range(6):
        d, text, lang, source = given[k]
        rows += [(given[k + 10][0], text, lang, source), (d, text + " one more word", lang, source), (None, text, lang, source), (d, f"Another text about {k} that nobody else has written so far", lang, None)]
    rows += [(7, None, "en", "a"), (7, "", None, "a"), (7, " 12 34 ", "en", "b"), (None, None, None, None), (8, "\n", "en", "a"), given[3], given[3]]
    return [(*r, len(r[1] or ""), f"t{k}", k) for k, r in enumerate(rows)]


def test_chain_with_repeated_and_null_ids_and_clashing_names(spark, sf, tmp_path):
    rows = odd_corpus(spark, sf)
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, `__gone` long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(f"{tmp_path}/pages.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    content = lambda r: (r[0], r[1], r[2], r[3], r[4])  # noqa: E731  equal rows may stand for each other
    got = stages["language_id"](spark, docs, str(tmp_path)).cache()
    assert got.columns == docs.columns
    want = [r for r in rows if re.search("[^\\W\\d_]", r[1] or "")]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    want = plain_dedup(want)
    got = stages["exact_dedup"](spark, got, str(tmp_path)).cache()
    assert got.columns == docs.columns and Counter(map(content, got.collect())) == Counter(map(content, want))
    before = [tuple(r) for r in got.collect()]
    got = stages["ngram_join"](spark, got, str(tmp_path)).cache()
    assert got.columns == docs.columns
    kept, groups = Counter(map(tuple, got.collect())), near_groups(before)
    assert sum(kept.values()) == len(groups) < len(before)
    for group in groups:  # one row of each stays, one of the smallest id
        (stays,) = [r for r in group if kept[r]]
        assert all((stays[0] is None, stays[0] or 0) <= (r[0] is None, r[0] or 0) for r in group)
    # Blank and null texts by themselves: copies are one group, and link with nothing.
    assert stages["exact_dedup"](spark, docs.filter("n_chars < 2"), str(tmp_path)).count() == 1
    assert stages["ngram_join"](spark, docs.filter("n_chars < 2"), str(tmp_path)).count() == docs.filter("n_chars < 2").count()
    mixed = stages["mixing"](spark, got, str(tmp_path)).cache()
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(map(tuple, got.collect()))
    test_packing.check(mixed, stages["packing"](spark, mixed, str(tmp_path)))
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == Counter(map(tuple, stages["packing"](spark, mixed, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_chain_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(f"{tmp_path}/pages.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_equals_its_stages(spark, sf):
    placed = corpus_pipeline.run(spark, sf)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert placed.count() > 0


def test_entry_lists_the_pipeline(spark, sf):
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(e.oracle_sql()) <= set(q)
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
