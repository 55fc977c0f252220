import hashlib
import math
from collections import Counter

from quillspark.llm import mixing as op


def poisson_count(u, rate):
    whole = math.floor(rate - op.LARGEST_RATE) if rate > op.LARGEST_RATE else 0
    rate -= whole
    k, term = 0, math.exp(-rate)
    cdf = term
    while cdf < u:
        k += 1
        term *= rate / k
        cdf += term
    return whole + k


def draw(seed, doc):
    return (int(hashlib.md5(f"{seed}:n:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_copies_follow_the_inverse(small):
    rows = op.mix(small, weights={"src1": 3.0, "src2": 1.0, "src3": 0.01}, with_position=True).collect()
    volume = Counter()
    for r in small.collect():
        volume[r["source"]] += len(r["text"])
    total, aims = sum(volume.values()), {"src1": 3.0, "src2": 1.0, "src3": 0.01}
    want = Counter()
    for r in small.collect():
        rate = aims.get(r["source"], 0.0) / sum(aims.values()) * total / volume[r["source"]]
        if n := poisson_count(draw(op.SEED, r["doc_id"]), rate):
            want[r["doc_id"]] = n
    assert Counter(r["doc_id"] for r in rows) == want
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)


def test_plan_is_native(small):
    mixed = op.mix(small, with_position=True)
    assert op.mix(small).columns == small.columns
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_odd_rows(odd, nothing):
    out = op.mix(odd, with_position=True)
    assert out.columns[:5] == odd.columns and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows)[3] % 2 == 0  # repeated rows draw alike
    clash = odd.withColumnRenamed("uid", "COPY")
    assert op.mix(clash, with_position=True).columns[4:6] == ["COPY", "_copy"]
    assert op.mix(nothing).count() == 0


def test_salted_rates_give_the_same(small, monkeypatch):
    a = op.mix(small, with_position=True).select("doc_id", "copy", "order_key").collect()
    monkeypatch.setattr(op, "BROADCAST_SOURCES", 0)
    b = op.mix(small, with_position=True).select("doc_id", "copy", "order_key").collect()
    assert sorted(a) == sorted(b)


def inverse(u, rate):
    """The least k at which the distribution function reaches u, each term from its logarithm."""
    k, cdf = 0, math.exp(-rate)
    while cdf < u:
        k += 1
        cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_large_rates_are_poisson(spark):
    rates = [0.0, 0.5, 29.9, 31.0, 100.0, 180.0, 399.0, 401.0, 1000.0, 5000.0]
    rows = [((i * 7919 % 997 + 0.5) / 997, r) for r in rates for i in range(0, 997, 5)] + [(u, r) for r in rates for u in (1e-9, 1 - 1e-9)]
    df = spark.createDataFrame(rows, "u double, rate double")
    for r in df.select("u", "rate", op.poisson_inverse(df.u, df.rate).alias("k")).collect():
        assert r["k"] == inverse(r["u"], r["rate"]), r


def test_copies_of_large_rates_follow_the_inverse(spark):
    df = spark.createDataFrame([(i, "small", "x") for i in range(200)] + [(1000, "large", "y" * 19_800)], "doc_id long, source string, text string")
    n = {r["doc_id"]: r["n_copies"] for r in op.mix(df, weights={"small": 1.0, "large": 1.0}, with_position=True).collect()}  # 20000 / 2 / 200 = 50
    assert {i: n.get(i, 0) for i in range(200)} == {i: inverse(draw(op.SEED, i), 50.0) for i in range(200)}
    assert min(n[i] for i in range(200)) < 40 and max(n[i] for i in range(200)) > 60
