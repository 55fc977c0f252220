import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import langid as op


def test_held_out_accuracy(spark):
    """Rows of even id lend no label to the fit; the answers for them are held against the label they have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    shown = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, F.col("lang")))
    found = op.identify(shown, op.page_evidence(pages), sample=150)
    rows = found.join(docs.filter("doc_id % 2 = 0").selectExpr("doc_id", "lang as truth"), "doc_id").collect()
    assert sum(r["lang"] == r["truth"] for r in rows) >= 0.99 * len(rows) and sum(r["accepted"] for r in rows) >= 0.99 * len(rows)


def brute_posteriors(docs, pages, langs, table):
    """The definition, row by row: (doc_id, text) and (doc_id, markup code, address code, host) to posteriors by row."""
    n = len(langs)
    ll = [table[:, op.trigrams(t or "")].sum(axis=1, dtype=float) * op.TEMPER for _, t, _ in docs]
    guess = [int(x.argmax()) if len(op.trigrams(t or "")) else n - 1 for x, (_, t, _) in zip(ll, docs)]
    shown = [[p for p in pages if p[0] == d] for d, _, _ in docs]
    hosts = [Counter(p[3] for p in ps) if ps else Counter([s or ""]) for ps, (_, _, s) in zip(shown, docs)]
    domain = lambda h: ".".join(h.split(".")[-2:])
    out = []
    for i in range(len(docs)):
        others = [j for j in range(len(docs)) if j != i]
        share = lambda tally, base: [(tally[k] + op.SMOOTHING * base[k]) / (sum(tally.values()) + op.SMOOTHING) for k in range(n)]
        corpus = [(sum(guess[j] == k for j in others) + 1) / (len(others) + n) for k in range(n)]
        prior = np.zeros(n)
        for h, w in hosts[i].items():
            near = share(Counter(guess[j] for j in others if any(domain(x) == domain(h) for x in hosts[j])), corpus)
            prior += w / sum(hosts[i].values()) * np.array(share(Counter(guess[j] for j in others if h in hosts[j]), near))
        score = ll[i] + np.log(prior)
        for part in (1, 2):
            for k in range(n):
                seen = {e: 0.5 + sum(sum(p[part] == e for p in shown[j]) / len(shown[j]) for j in others if guess[j] == k and shown[j]) for e in langs[:-1]}
                for p in shown[i]:
                    if p[part] in seen:
                        score[k] += np.log(seen[p[part]] / sum(seen.values())) / len(shown[i])
        post = np.exp(score - score.max())
        out.append(post / post.sum())
    return out


def test_posteriors_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = {"en": "the house of king and road is long".split(), "de": "das haus des weg und ist lang alt".split(), "fr": "la maison du roi et route est".split()}
    docs = []
    for k in range(80):
        lang = rng.choice(list(words))
        docs.append((k, " ".join(rng.choices(words[lang], k=rng.choice([1, 1, 2, 30]))), lang if k % 3 else None, rng.choice(["s", "t", None])))
    docs += [(3, "die alt", None, "s"), (None, "house", None, "t"), (90, None, None, "s"), (91, "xqz", None, "s")]
    pages = [(rng.randrange(85), f"http://{rng.choice('abc')}.{rng.choice(['x', 'y'])}.org/{rng.choice(['en', 'de', 'zz'])}/1", rng.choice(["en", "de", "fr", None])) for _ in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    evidence = spark.createDataFrame([(d, m, a) for d, a, m in pages], "doc_id long, markup string, address string")
    langs, table = op.fit(df, "doc_id", "text", "lang")
    plain = [(d, m, a.split("/")[3], a.split("/")[2]) for d, a, m in pages]
    want = Counter()
    for (d, t, _, _), post in zip(docs, brute_posteriors([(d, t, s) for d, t, _, s in docs], plain, langs, table)):
        best = int(post.argmax()) if len(op.trigrams(t or "")) else len(langs) - 1
        want[d, langs[best], round(float(post[best]), 6)] += 1
    for most in (op.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(op, "BROADCAST_HOSTS", most)
        rows = op.identify(df, evidence).collect()
        assert Counter((r["doc_id"], r["lang"], round(r["confidence"], 6)) for r in rows) == want
    assert any(r["lang"] != r["text_lang"] for r in rows)  # the evidence turns some short texts


def test_address_language(spark):
    rows = [("http://a.de/x", "a.de", "de"), ("https://B.example.org/en/12?x=1", "b.example.org", "en"), ("http://x.co.uk", "x.co.uk", "en"), ("http://x.com/fr#top", "x.com", "fr"), ("junk", "junk", ""), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "u string")
    got = df.select("u", *op.address_language(df["u"])).collect()
    assert [(r[0], r[1], r[2]) for r in got] == rows


def test_evidence_decides_where_the_text_is_short(spark):
    en, de = "the house of the king is old and the road is long " * 5, "das haus des königs ist alt und die straße ist lang " * 5
    docs = [(k, en if k % 2 else de, "en" if k % 2 else "de", "s", 1) for k in range(60)] + [(100, "alt", None, "s", 1), (101, "alt", None, "s", 1), (102, "漢字漢字" * 40, None, "s", 1), (103, "12 34 !", None, "s", 1), (104, None, None, None, 1), (105, "", None, "s", 1), (None, en, "en", "s", 1), (1, en, "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, host int").repartition(3)
    pages = [(k, f"http://h{k % 2}.example.org/{'en' if k % 2 else 'de'}/{k}", f"<html lang={'en' if k % 2 else 'de'}>") for k in range(60)] + [(900, "http://h1.example.org/en/100", "<html lang='en'>"), (901, "http://h0.example.org/de/101", "<html lang='de-AT'>"), (902, None, None), (903, "http://h1.example.org/en/101", None)]
    evidence = op.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = op.identify(df, evidence).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang"] == ("en" if k % 2 else "de") for k in range(60))
    assert by[100]["lang"] == "en" and by[101]["lang"] == "de"
    for d in (102, 103, 104, 105):
        assert by[d]["lang"] == op.UND and not by[d]["accepted"]
    assert by[None]["lang"] == "en" and by[None]["accepted"]


def test_nothing_and_no_labels(nothing, odd):
    assert op.identify(nothing).count() == 0
    rows = op.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["lang"] == op.UND and not r["accepted"] for r in rows) and len(rows) == odd.count()


def test_very_long_text_and_blanks():
    assert len(op.trigrams("a" * 1_000_000)) == 1_000_000 and len(op.trigrams("")) == 0 and len(op.trigrams(" \n1!")) == 0
    assert np.array_equal(op.trigrams("ab  c"), op.trigrams("AB-c"))
