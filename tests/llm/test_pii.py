import hashlib
import math
import random
import re
import time

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import pii as op

CARD = "4539 1488 0343 6467"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1234567890@.+-% ()_é\n", max_size=80))
def test_base_spans_equal_the_patterns(text):
    assert op.base_spans(text) == brute.spans(text)


def test_base_spans_of_long_runs():
    assert op.base_spans("a" * 200_000 + "@") == [] and op.base_spans("1" * 200_000 + ".2") == []
    assert op.base_spans("@a.b x@y.z@q.r") == brute.spans("@a.b x@y.z@q.r")
    assert op.base_spans(f"{CARD} 1.2.3.4.5.6.7.8 1.2.3.999 +1 (017) 555-7713") == brute.spans(f"{CARD} 1.2.3.4.5.6.7.8 1.2.3.999 +1 (017) 555-7713")


ROWS = [
    (1, f"patient Zorblax paid with {CARD} on monday at noon", "x"),
    (2, f"invoice for the zorblax, sent; {CARD} was charged twice today", "y"),
    (3, "paid with cash on monday at noon by someone else", None),
    (4, f"patient Zorblax paid with {CARD} on monday at noon", "copy of 1"),
    (5, None, None),
    (6, "", ""),
    (7, "mail a.b@c.org and a.b@c.org, ip 10.0.0.1", ""),
    (None, "phone +1 (017) 555-7713", ""),
    (8, "x " * 50_000 + "z@z.zz", ""),
] + [(100 + k, "the charged invoice was paid with cash on monday at noon today", "") for k in range(30)]


def test_disclosing_terms_are_added(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, spans string").repartition(4)
    rows = {r["doc_id"]: r for r in op.find_personal_data(df).collect()}
    assert len(rows) == len(ROWS)
    for d, t, _ in ROWS:
        base = brute.spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[d]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in op.KINDS] == [sum(x[0] == k for x in base) for k in op.KINDS]
        assert r["spans"].startswith(joined)
    terms = lambda d: {next(t for i, t, _ in ROWS if i == d)[int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[d]["spans"].split(",") if s) if k == "term"}
    # The name comes with the card in two different contexts; other words come without it too often.
    assert terms(1) == terms(4) == {"Zorblax"} and terms(2) == {"zorblax"}
    assert not terms(3) and not terms(7)
    # More support than there are contexts (copies are one) adds nothing.
    assert op.find_personal_data(df, support=3).agg({"n_term": "sum"}).first()[0] == 0
    clean = {r["doc_id"]: r["text"] for r in op.sanitise(df.filter("doc_id is not null")).collect()}
    assert clean[1] == "patient [TERM] paid with [CARD] on monday at noon" and clean[5] is None and clean[3] == ROWS[2][1]


def test_nothing(spark):
    assert op.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def terms_in(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: {dict(rows)[r["doc_id"]][int(a) : int(b)] for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"} for r in op.find_personal_data(df).collect()}


FILLER = [(100 + k, f"nothing about anyone in number {k}") for k in range(60)]


def test_disclosing_terms_are_found_wherever_they_stand(spark):
    far = " one two six ten out now" * 3
    rows = [(1, f"Zorblax paid {CARD} early{far} zorblax"), (2, f"later zorblax used {CARD} again"), (3, f"seen with{far} Zorblax, alone"), *FILLER]
    got = terms_in(spark, [r for r in rows if r[0] != 3])
    assert got[1] == {"Zorblax", "zorblax"} and got[2] == {"zorblax"}
    got = terms_in(spark, [*rows, (4, f"zorblax and {CARD} once more")])  # without the entity too: three of four texts have it
    assert got[3] == {"Zorblax"} and got[1] == {"Zorblax", "zorblax"} and not got[100]


def test_terms_count_over_the_whole_text_of_an_entity(spark):
    gap = "one two six ten out now far off"
    # Seven words away, and beside the mention in one of two texts only; equal surroundings in different texts are two.
    rows = [(1, f"first Qwertzy {gap} {CARD}"), (2, f"other {CARD} {gap} qwertzy"), *FILLER]
    got = terms_in(spark, rows)
    assert "Qwertzy" in got[1] and "qwertzy" in got[2]
    rows = [(1, f"dear anna {gap} {gap} call Xandor now {CARD}"), (2, f"dear bert {gap} {gap} call Xandor now {CARD}"), *FILLER]
    got = terms_in(spark, rows)
    assert "Xandor" in got[1] and "Xandor" in got[2] and "anna" not in got[1]


def brute_terms(rows, threshold=op.THRESHOLD, support=op.SUPPORT, smoothing=op.SMOOTHING):
    """The definition of the disclosing terms, over all pairs."""
    docs = []
    for _, text in rows:
        text, spans = text or "", brute.spans(text)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        outside = {op.term_of(w) for a, z, w in words if not any(a < y and x < z for _, x, y in spans)}
        held = set()
        for k, a, b in spans:
            v = text[a:b].lower() if k == "email" else text[a:b] if k == "ip" else re.sub("[^0-9]", "", text[a:b])
            held |= {(k, v), *([("domain", v.split("@")[-1])] if k == "email" else [])}
        docs.append((" ".join(text.split()), held, {t for t in outside if len(t) >= op.SHORTEST}))
    n, out = max(2, len(docs)), set()
    near = set().union(*(t for _, held, t in docs if any(len({p for p, h, _ in docs if e in h}) >= support for e in held)), set())
    for e in set().union(*(h for _, h, _ in docs)):
        with_e = [d for d in docs if e in d[1]]
        if len({d[0] for d in with_e}) < support:
            continue
        p = len(with_e) / n
        for t in near:
            both = [d for d in with_e if t in d[2]]
            if len({d[0] for d in both}) < support or p >= 1 or len(both) * -math.log(p) <= math.log(max(1, len(near))):
                continue
            given_t = (len(both) + smoothing * p) / (sum(t in d[2] for d in docs) + smoothing)
            if math.log(given_t / p) / -math.log(p) >= threshold:
                out.add(t)
    return out


def test_disclosing_terms_against_brute_force(spark, small):
    """Given texts with planted names that go with an address, a card and a company's domain."""
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in small.orderBy("doc_id").limit(90).collect()]
    for k in range(8):
        filler = " ".join(rng.choices("north south east west river stone paper glass".split(), k=9))
        rows.append((10_000 + k, f"{filler} Quillhart {'wrote' if k % 2 else 'said'} to jane.doe@acme.example.org {rng.random()}"))
        rows.append((10_100 + k, f"the Brandol works, {filler} {rng.choice('abcdef')}{k}@brandol.example.net"))
        rows.append((10_200 + k, f"{filler} {'Vexler' if k < 5 else 'nobody'} and {CARD} {k}"))
    rows += [(10_300, "Quillhart alone"), (None, "Brandol alone"), (10_301, None), rows[-1], rows[-2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_terms(rows)
    assert {"quillhart", "brandol"} <= want
    got = {r["term"] for r in op.disclosing_terms(df.select("text"), op.THRESHOLD, op.SUPPORT, op.SMOOTHING).collect()}
    assert got == {op._signed(t.encode()) for t in want}
    held = op._Among
    try:  # many keys go through a filter, and joins decide
        op._Among = lambda keys: type("F", (), {"__call__": lambda self, h, p=op.Passing(keys): p(h)})()
        assert {r["term"] for r in op.disclosing_terms(df.select("text"), op.THRESHOLD, op.SUPPORT, op.SMOOTHING).collect()} == got
    finally:
        op._Among = held
    clean = {r["doc_id"]: r["text"] for r in op.sanitise(df).collect()}
    assert clean[10_300] == "[TERM] alone" and clean[None] == "[TERM] alone" and clean[10_301] is None


def test_directories_of_very_many_addresses(spark):
    """Two texts with 10,000 addresses each, a third of them in a text of their own too: no product of a text's entities and terms."""
    address = lambda k: f"{op.term_of(f'q{k}x')}@h{k}.example.org"
    rows = [(d, f"list {d} " + " ".join(f"Name{k}z {address(k)}" for k in range(10_000))) for d in (1, 2)]
    rows += [(10 + k, f"letter {k} from Name{k}z at {address(k)} and Other{k}y") for k in range(0, 10_000, 3)]
    rows += [(20_000 + k, f"nothing about anyone in number {k}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    start = time.time()
    got = {r["doc_id"]: r["n_term"] for r in op.find_personal_data(df).filter("doc_id < 20000").collect()}
    assert time.time() - start < 90
    # The names and the word "list", which only the two texts have.
    assert got[1] == got[2] == 10_001 and all(got[10 + k] == 1 for k in range(0, 10_000, 3))


def test_pairs_equal_all_pairs(spark):
    """Documents of shared and own entities and terms: the pairs of two places are those of the whole product."""
    rng = random.Random(4)
    docs = [(d, rng.randrange(25), rng.sample(range(12), rng.randint(1, 9)), rng.sample(range(100, 130), rng.randint(0, 20))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc long, place long, entities array<long>, terms array<long>").repartition(3)
    for support in (1, 2, 3):
        places: dict = {}
        for _, p, held, terms in docs:
            for pair in ((e, t) for e in held for t in terms):
                places.setdefault(pair, []).append(p)
        want = {pair: len(p) for pair, p in places.items() if len(set(p)) >= support}
        got = op._supported(op._pairs(op.staged(df, "docs"), support), ["entity", "term"], support, "n").collect()
        assert {(r["entity"], r["term"]): r["n"] for r in got} == want
