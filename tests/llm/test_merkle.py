import hashlib
import random
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle as op
from quillspark.llm import queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes, fanout):
    """The root over ``nodes`` and for each node its siblings, left and right, by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for k, p in enumerate(at):
            run, own = runs[p // fanout], p % fanout
            paths[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[k] = p // fanout
        level = [h(*r) for r in runs]
    return level[0], paths


def brute(rows, fanout):
    """doc_id, leaf, subroot, root, path, folded root of (id, group, leaf, shown)."""
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] is not None, r[3] or ""))
        done[g] = (own, *reduced([r[2] for r in own], fanout))
    root, tops = reduced([done[g][1] for g in names], fanout)
    for g, top in zip(names, tops):
        own, subroot, paths = done[g]
        for r, path in zip(own, paths):
            fold = r[3] or r[2]
            for left, right in path + top:
                fold = h(left, fold, right)
            out.append((r[0], r[2], subroot, root, tuple(path + top), fold, fold == root))
    return sorted(out, key=str)


def made(df, fanout=2):
    got = op.manifest(df, F.col("leaf"), F.col("shown"), "id", "grp", fanout)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"]), r["folded_root"], r["verified"]) for r in got.collect()), key=str)


SCHEMA = "id long, grp string, leaf string, shown string, uid string"


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_random_tables_equal_brute_force(spark, fanout):
    rng = random.Random(fanout)
    rows = []
    for g, n in ((None, 1), ("", 2), ("a", 300), ("é", 37), ("=", 5), ("-", 1)):
        rows += [(k, g, h(g or "none", str(k)), h("forged") if k % 7 == 3 else None, "x") for k in rng.sample(range(-(10**9), 10**12), n)]
    rng.shuffle(rows)
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout) == brute([r[:4] for r in rows], fanout)


def test_ranks_of_extreme_and_repeated_ids(spark, monkeypatch):
    """Both ends of the number range, null ids, ids with many rows, and equal rows, which have neighbouring places."""
    monkeypatch.setattr(op, "ROWS_AN_ID", 4)
    rows = [(k, "g", h(str(k)), None, "x") for k in (-(2**63), 2**63 - 1, 0, 255, 256, -1)] + [(7, "g", h("many", str(k)), None, "x") for k in range(60)]
    rows += [(None, "g", h("none", str(k)), None, "x") for k in range(3)] + [(9, "g", h("same"), None, "x")] * 5
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute([r[:4] for r in rows], 2)


def test_a_single_row_and_an_empty_table(spark):
    rows = [(1, "g", h("1"), None, "x")]
    assert made(spark.createDataFrame(rows, SCHEMA)) == [(1, h("1"), h("1"), h("1"), (), h("1"), True)]
    assert made(spark.createDataFrame([], SCHEMA)) == []


def test_odd_documents(spark, odd):
    leaf = op.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "text")))
    rows = op.manifest(odd, leaf).collect()
    assert len(rows) == odd.count() and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    assert sorted(r["leaf"] for r in rows) == sorted(h(*map(said, (r["doc_id"], r["source"], r["lang"], r["text"]))) for r in odd.collect())


def test_query_equals_its_sql_and_finds_what_was_forged(spark, sf):
    got = queries.op12_merkle_manifest(spark, sf).cache()
    assert compare.rows_of(got) == compare.oracle_rows(compare.connect(sf), queries.ORACLES["op12_merkle_manifest"])
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in got.select("doc_id", "verified").collect())
