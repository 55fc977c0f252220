import random

import pytest

from quillspark.llm import components as op


@pytest.mark.parametrize("few", [True, False])
def test_components_of_stars_chains_and_random_edges(spark, monkeypatch, few):
    """With all minima broadcast, and with those of vertices of many edges only."""
    if not few:
        monkeypatch.setattr(op, "BROADCAST_KEYS", 8)
        monkeypatch.setattr(op, "LEAST_HOT", 20)
    rng = random.Random(1)
    edges = [(7, k) for k in range(100, 260)] + [(k, k + 1) for k in range(1000, 1040)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = [(r["v"], r["root"]) for r in op.connected_components(df).collect()]
    assert len(got) == len(want) and dict(got) == want
