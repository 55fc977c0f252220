import random

import pytest
from plain import check_packs, check_parts, solid, tidy
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking, segment
from quillspark.profiles import SLOVENIAN_LAW as P


@pytest.fixture
def read(spark):
    def run(*texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "pos int, t string")
        return [r.asDict() for r in segment.articles(df, "t", P).orderBy("pos", "article_idx").collect()]

    return run


def test_basic_articles(read):
    a = read("Uvod\n1. člen\n(Namen)\nPrvi odstavek.\n2. ČLEN\nDrugi.")
    assert [(x["article_number"], x["article_label"], x["article_heading"], x["article_body"]) for x in a] == [("1", "1. člen", "Namen", "Prvi odstavek."), ("2", "2. člen", None, "Drugi.")]


def test_blank_line_before_a_heading_belongs_to_the_match(read):
    assert read("\n\n1. člen\nx")[0]["article_start"] == 0


def test_forward_style(read):
    assert [x["article_body"] for x in read("Člen 5 abc\nx\nČlen 6\ny")] == ["Člen 5 abc\nx", "y"]
    assert read("Člen 6\ny")[0]["article_label"] == "Člen 6"


def test_roman_articles_only_without_arabic_ones(read):
    assert read("IV. člen\nx")[0]["article_number"] == "IV"
    assert len(read("IV. člen\nx\n1. člen\ny")) == 1


def test_chapters_govern_from_their_place_on(read):
    a = read("1. člen\na\nI. SPLOŠNE DOLOČBE\n2. člen\nb\n2. poglavje\n3. člen\nc\n4. člen\nd")
    assert [x["chapter"] for x in a] == [None, "I. SPLOŠNE DOLOČBE", "2. poglavje", "2. poglavje"]
    assert [x["article_body"] for x in a] == ["a", "b", "c", "d"]


def test_chapter_label_swallows_capital_lines(read):
    assert read("I. SPLOŠNE\n\nABC\nx\n1. člen\ny")[0]["chapter"] == "I. SPLOŠNE\n\nABC"


def test_headings_of_two_patterns_that_overlap(read):
    """Each pattern finds its own: the number before a line end, and the forward heading after it."""
    a = read("1.\nčlen 5\nx")
    assert [(x["article_number"], x["article_label"], x["article_body"]) for x in a] == [("1", "1. člen", ""), ("5", "Člen 5", "x")]


def test_one_block_of_each_kind(read):
    """Every kind of line once, with what comes of it."""
    a = read("PRVI DEL\nuvod\n 1. člen \r\n(Namen)\r\n\r\nprvo\r\nČlen 2 je nov\ndrugo\nI. SPLOŠNE DOLOČBE\n3. člen ostane\n1. Dobiček je razlika\n(a) b (c)\ntretje\x85konec\n12\nčlen 9\nx")
    keys = ("article_number", "article_label", "article_heading", "article_body", "chapter")
    assert [tuple(x[k] for k in keys) for x in a] == [
        ("1", "1. člen", "Namen", "prvo", "PRVI DEL"),
        ("2", "Člen 2", None, "Člen 2 je nov\ndrugo", "PRVI DEL"),
        ("3", "3. člen", None, "ostane\n(a) b (c)\ntretje\nkonec\n12", "I. SPLOŠNE DOLOČBE"),
        ("9", "Člen 9", None, "x", "I. SPLOŠNE DOLOČBE"),
    ]


def test_three_kinds_of_chapters_and_roman_articles(read):
    a = read("I. SPLOŠNE DOLOČBE\nI. člen\na\nII. DEL, 2/3\nii. člen\nb\n3. Oddelek o davkih\nIII. člen\nc\ndrugi del\nIV. člen\nd")
    assert [(x["article_number"], x["chapter"], x["article_body"]) for x in a] == [("I", "I. SPLOŠNE DOLOČBE", "a"), ("ii", "II. DEL, 2/3", "b"), ("III", "3. Oddelek o davkih", "c"), ("IV", "drugi del", "d")]


PIECES = ["1. člen", "2. ČLEN", "Člen 3", "Člen 4 je nov", "IV. člen", "(Namen)", "(a) b (c)", "I. SPLOŠNE DOLOČBE", "2. poglavje o davkih", "PRVI DEL", "1. Dobiček je razlika", "besedilo odstavka.", "", "  ", "12", "člen", "\x85"]
STRUCTURAL = {"I. SPLOŠNE DOLOČBE", "2. poglavje o davkih", "PRVI DEL", "1. Dobiček je razlika"}


def test_random_acts_keep_their_lines(spark):
    """Starts rise, numbers are those of the headings, bodies hold lines of the act but no structural one, chapters stand before."""
    rng = random.Random(11)
    texts = [rng.choice(["", "\n", " "]) + rng.choice(["\n", "\r\n"]).join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "pos int, t string").repartition(4)
    got: dict = {}
    for r in segment.articles(df, "t", P).orderBy("pos", "article_idx").collect():
        got.setdefault(r["pos"], []).append(r)
    for k, text in enumerate(texts):
        rows, held = got.get(k, []), [x.strip() for x in (text or "").splitlines()]
        arabic = any(x in ("1. člen", "2. ČLEN", "Člen 3", "Člen 4 je nov") for x in held)
        numbers = {"1. člen": "1", "2. ČLEN": "2", "Člen 3": "3", "Člen 4 je nov": "4"} if arabic else {"IV. člen": "IV"}
        if "člen" not in held and "\x85" not in (text or ""):  # that line may make a heading with its neighbours
            assert [r["article_number"] for r in rows] == [numbers[x] for x in held if x in numbers], text
        assert [r["article_start"] for r in rows] == sorted({r["article_start"] for r in rows})
        for r in rows if "člen" not in held else []:
            assert not STRUCTURAL & set(r["article_body"].splitlines()) and set(r["article_body"].splitlines()) <= {*held, ""}
            assert r["chapter"] is None or solid(r["chapter"]) in solid(text[: r["article_start"]])


def test_structural_lines_and_heading_misfire(read):
    assert read("1. člen\n1. Dobiček je razlika\nx")[0]["article_body"] == "x"
    a = read("1. člen\n(1) text (2)")[0]
    assert a["article_heading"] == "1) text (2" and a["article_body"] == ""


def test_leading_noise(spark):
    t = "ZAKON o davku\n\nOpozorilo: x\nUvod\n1. člen\n\nZAKON ostane"
    rows = {t: "Uvod\n1. člen\n\nZAKON ostane", "IV. člen\nZAKON x\n\ny": "IV. člen\ny", "": "", None: "", "a \u00a0b \x85c\r\nd": "a b\nc\nd"}
    df = segment.with_clean_text(spark.createDataFrame([(k,) for k in rows], "t string"), "t", P, "clean")
    assert [r["clean"] for r in df.collect()] == list(rows.values())


def parts_of(spark, column, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").repartition(3)
    return [r["x"] for r in df.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_body_parts(spark):
    """Paragraphs lose what stands before them, list items keep it, inner articles begin their parts."""
    bodies = [
        "uvod " * 5 + "\n(1) " + "a " * 40 + "\n(2) " + "b " * 40,
        "uvod:\n1. " + "a" * 60 + "\n2. " + "b" * 60,
        "x\na) " + "a" * 60 + "\nb) " + "b" * 60,
        "head " * 10 + "\nArticle 1\n" + "x " * 30 + "\nArticle II\n" + "y " * 30,
        "short",
        "",
    ]
    bodies = [tidy(b) for b in bodies]
    got = parts_of(spark, lambda c: chunking.split_body(c, 100, P), bodies)
    assert got[0][0].startswith("(1)") and got[1] == ["uvod:\n1. " + "a" * 60, "2. " + "b" * 60] and got[2][1].startswith("b)")
    assert got[3][0].startswith("head") and any(p.startswith("Article II") for p in got[3]) and got[4:] == [["short"], [""]]
    assert [len(p) for p in got] == [2, 2, 2, 3, 1, 1] and all(len(x) <= 100 for p in got for x in p)
    assert solid("".join(got[0])) == solid(bodies[0][bodies[0].index("(1)") :])  # paragraphs lose what stands before them
    assert all(solid("".join(p)) == solid(b) for p, b in zip(got[1:], bodies[1:]))


def random_texts(seed, n, pieces, most):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, most))) for _ in range(n)]


LETTERS = list("ab .;:\n1 \tč(") + ["aaaaaaaa", ". ", "bbbb ", "😀"]


@pytest.mark.parametrize("most", [10, 30, 61])
def test_cuts_lie_where_they_should(spark, most):
    texts = [tidy(t) for t in random_texts(most, 400, LETTERS, 120)] + ["x" * 250, "a" * 60 + ". " + "b" * 45 + ". " + "c" * 20]
    got = parts_of(spark, lambda c: chunking.split_long(c, most), texts)
    for text, parts in zip(texts, got):
        check_parts(text, parts, most)


def test_cuts_by_hand(spark):
    texts = ["aaaa bbbb cccc dddd", "aaaaaaa. bb; cc ddd", "a. 1. bbbbbbbbbbbbbb", "abcdefghijklmnopqrstu", "aaaaaa\nbbbbbb", "aaa;\n\nbbbbbbbbbbb", None]
    assert parts_of(spark, lambda c: chunking.split_long(c, 10), texts) == [
        ["aaaa bbbb", "cccc dddd"],
        ["aaaaaaa.", "bb; cc ddd"],
        ["a. 1.", "bbbbbbbbb", "bbbbb"],
        ["abcdefghij", "klmnopqrst", "u"],
        ["aaaaaa", "bbbbbb"],
        ["aaa;", "bbbbbbbbbb", "b"],
        None,
    ]


def test_long_texts_take_time_in_proportion(spark):
    import time

    took = []
    for n in (1, 1, 4):
        df = spark.createDataFrame([("Stavek je tu. " * (27_000 * n),)], "t string")
        start = time.time()
        parts = df.select(chunking.split_long(F.col("t"), 1500).alias("p")).first()["p"]
        took.append(time.time() - start)
    assert len(parts) > 1000 and took[2] < 3 + 6 * took[1]


@pytest.mark.parametrize("most", [20, 61])
def test_packs_are_whole_and_full(spark, most):
    rng = random.Random(most)
    lists = [random_texts(rng.random(), rng.randint(0, 8), LETTERS, 40) for _ in range(300)]
    for units, parts in zip(lists, parts_of(spark, lambda c: chunking.pack(c, most), lists, "array<string>")):
        check_packs(units, parts, most)


def test_random_bodies_fit_and_begin_at_markers(spark):
    lines = ["(1) prvi odstavek", "(2) drugi je daljši od prvega", "1. točka", "2) točka z besedilom", "a) alineja", "č) še ena", "Article 3", "IV. člen – naslov", "navadno besedilo brez oznak.", "", "uvod:"]
    rng = random.Random(9)
    bodies = [tidy("\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for _ in range(400)]
    for body, parts in zip(bodies, parts_of(spark, lambda c: chunking.split_body(c, 60, P), bodies)):
        assert all(len(p) <= 60 for p in parts)
        if len(body) <= 60:
            assert parts == [body]
        elif (inner := sum(x in ("Article 3", "IV. člen – naslov") for x in body.splitlines())) > 1:
            assert solid("".join(parts)) == solid(body)
        elif sum(x.startswith("(") for x in body.splitlines()) > 1:
            assert parts[0].startswith("(") and solid("".join(parts)) == solid(body[body.index("(") :]), inner
        else:
            assert solid("".join(parts)) == solid(body)


def test_spans_equal_finditer(spark):
    import re

    texts = ["1. člen a\n 22. člen", "", "x", "\n\n3. ČLEN 😀\n4. člen\n"]
    rx = r"\d+\.\s*člen"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(s["start"], s["stop"], s["match"]) for s in r[0]] for r in df.select(T.spans(df["t"], f"(?iuUd){rx}")).collect()]
    assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer(rx, t, re.I)] for t in texts]


def records(spark, texts, title="Zakon o davku (ZDDV-1)"):
    none = None
    rows = [(k, k, title, f"M{k}", none, none, none, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "record_pos long, id long, naziv string, mopedId string, eva string, epa string, sop string, text string")


def test_chunks(spark):
    long = "beseda " * 300
    df = records(spark, ["1. člen\n(N)\n" + long + "\n2. člen\nkratek\n2. člen\npogosto", "brez členov " * 200, ""])
    rows = chunking.chunks(df, P, 1000).orderBy("record_pos", "article_idx", "part_idx").collect()
    assert [r["chunk_id"] for r in rows] == ["M0_A1_PFULL_S1", "M0_A1_PFULL_S2", "M0_A1_PFULL_S3", "M0_A2_PFULL", "M0_A2_PFULL"]
    assert rows[0]["chunk_part"] == "1/3" and rows[3]["chunk_part"] is None and rows[0]["law_code"] == "ZDDV-1"
    assert rows[3]["formatted_text"] == "Zakon: Zakon o davku (ZDDV-1) | Oznaka: ZDDV-1 | Člen: 2. člen | Besedilo: kratek"
    assert rows[0]["domain_tags"] == ["tax", "vat"] and all(r["paragraph_number"] is None for r in rows)
    kept = chunking.chunks(df, P, 1000, keep_nonparsed=True).filter("record_pos = 1").orderBy("part_idx").collect()
    assert [r["chunk_id"] for r in kept] == [f"M1_ADOC_PFULL_S{k + 1}" for k in range(len(kept))] and len(kept) == 3
    one = chunking.chunks(records(spark, ["kratko"]), P, 1000, keep_nonparsed=True).collect()
    assert one[0]["chunk_id"] == "M0_ADOC_PFULL_S1" and one[0]["chunk_part"] is None


def test_index_flow(spark):
    from quillspark.plans.index import build_index

    df = records(spark, ["1. člen\ndavek", "nič", "2. člen\nx"]).unionByName(records(spark, ["1. člen\nx"], "Neznano").selectExpr("record_pos + 10 as record_pos", "id", "naziv", "mopedId", "eva", "epa", "sop", "text"))
    df = df.unionByName(records(spark, ["t"], None).selectExpr("record_pos + 20 as record_pos", "id", "naziv", "mopedId", "eva", "epa", "sop", "text"))
    made = build_index(df)
    assert {r["reason"]: r["n"] for r in made.filter_reasons.collect()} == {"whitelist": 3, "irrelevant": 1}
    c = made.counters.first()
    assert (c["records_total"], c["records_kept"], c["records_with_chunks"], c["records_no_chunks"], c["records_faulty"], c["chunks_total"], c["records_unreadable"]) == (5, 3, 2, 1, 1, 2, 1)
    assert sorted((r["record_pos"], r["error"]) for r in made.quarantine.collect()) == [(1, "no chunks"), (20, "title is null")]
    assert {r["law_code"]: r["n"] for r in made.chunks_by_law.collect()} == {"ZDDV-1": 2}
    strict = build_index(df, strategy="whitelist")
    assert {r["reason"] for r in strict.filter_reasons.collect()} == {"whitelist", "not_in_whitelist"}
    every = build_index(df, strategy="all-laws")
    assert every.quarantine.count() == 0 and every.counters.first()["records_with_chunks"] == 5


def test_needles_in_one_pass(spark):
    """Hits count different keywords; a thousand needles cost little more than ten."""
    import time

    from quillspark.functions import needles

    rows = ["Davek in davčni organ", "xDAVEKx", "nič", "", None]
    hits = parts_of(spark, lambda c: T.keyword_hits(c, ["davek", "DAVEK", "davčni", "organ", ""]), rows)
    assert hits == [5, 3, 1, 1, None]
    assert parts_of(spark, lambda c: needles.groups_found(c, {"b": ("davek", "x"), "a": ("ORGAN",), "c": ()}), rows) == [["a", "b"], ["b"], [], [], None]
    texts = spark.createDataFrame([(" ".join(f"beseda{(i * 7919 + j) % 997}" for j in range(300)),) for i in range(3000)], "t string").repartition(4).cache()
    took = {}
    for n in (10, 1000, 10, 1000):
        start = time.time()
        texts.select(F.sum(T.keyword_hits(F.col("t"), [f"beseda{k}x" for k in range(n)]))).collect()
        took[n] = time.time() - start
    assert took[1000] < 2 * took[10] + 0.5


def test_indexing_reads_the_records_once(spark):
    from quillspark.plans.index import build_index

    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = records(spark, ["1. člen\ndavek", "nič", "2. člen\nx"])
    made = build_index(df.mapInArrow(counted, df.schema))
    for part in (made.chunks, made.quarantine, made.counters, made.filter_reasons, made.records_by_law, made.chunks_by_law, made.tag_counts):
        part.collect()
    assert reads.value == 3


def test_line_starts_give_what_a_search_gives():
    import random
    import re

    from quillspark.functions import scan
    from quillspark.profiles import SLOVENIAN_LAW as P

    rules = [(p, re.MULTILINE | re.IGNORECASE) for p in (*P.articles, *P.roman_articles)] + [(p, 0) for p in (*P.chapters, P.paragraph, r"a\s+b", "^a|b", "(?m)^[|]x|y", "(?m)^(?:a|b)")]
    assert [scan._at_lines(*r) for r in rules] == [True] * 9 + [False, False, False, True]
    rng = random.Random(4)
    words = ["1. člen", "Člen 2", "IV. člen", "I. NASLOV", "3. oddelek a", "osmi del", "(1) ", "\n", "\n", " ", "\t", "\r\n", "\x85", "a", "b", "|x", "y"]
    for _ in range(3000):
        t = "".join(rng.choice(words) for _ in range(rng.randrange(14)))
        for r in rules:
            want = [m.span() for m in re.compile(*r).finditer(t)]
            assert [m.span() for m in scan._found(t, scan._starts(t), *r)] == want


def test_headings_and_words_take_bounded_time():
    """A bound on the CPU time of both, 0.15 microseconds a character."""
    import time

    from quillspark.functions import needles, scan
    from quillspark.profiles import SLOVENIAN_LAW as P

    line = "the und que se ado ciónga la osmiíco " * 8 + "\n"
    text, words, began = line * 3000, ("the ", "und ", " que ", "xyz"), time.process_time()
    assert needles._places(text, words) == {0, 1, 2}
    assert not [m for p in P.chapters for m in scan._found(text, scan._starts(text), p, 0)]
    assert time.process_time() - began < 0.15e-6 * len(text)


def test_lines_end_as_before(spark):
    from pyspark.sql import functions as F

    from quillspark.functions.text import lines, normalize_whitespace

    texts = ["", "\n", "a", "a\n", "a\r\n", "a\r\n\n", "\x85a\u2028b\x1c", "a\r\rb\n\r", "a  b\t c\u00a0d \u00a0", " \t", "a\n\n\n\nb\u00a0"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", lines(F.col("t")), normalize_whitespace(F.col("t"))).orderBy("k").collect()
    import re

    assert [r[1] for r in got] == [t.splitlines() for t in texts]
    assert [r[2] for r in got] == [re.sub("\n{3,}", "\n\n", re.sub("[\u00a0 \t]+", " ", re.sub("\r\n?", "\n", t))).strip() for t in texts]


def test_acts_of_many_lines_take_time_in_proportion(spark):
    """Each line is looked at a few times, whatever the number of lines: the lead of an act, its articles and their bodies."""
    import time

    from quillspark.plans.index import build_index

    took = []
    for n in (100, 100, 400):
        text = "\n".join(["ZAKON"] + ["Uvodna vrstica."] * n + [f"{k}. člen\n(Naslov)\nBesedilo {k}." for k in range(n)] + ["vrstica"] * n)
        start = time.time()
        got = build_index(records(spark, [text] * 4)).chunks.count()
        took.append(time.time() - start)
    assert got >= 4 * 400 and took[2] < 5 + 2 * took[1]


def test_counts_alone_need_no_texts(spark, monkeypatch):
    """Counters and counts are those of the whole index, and the texts of the chunks are neither made nor written."""
    from quillspark.plans import index

    written = []
    monkeypatch.setattr(index, "stored", lambda df, name, keep=index.stored: written.append((name, set(df.columns))) or keep(df, name))
    df = records(spark, ["1. člen\ndavek\n2. člen\nx", "nič", "3. člen\n" + "obresti " * 400, "1. člen\n" + "y" * 25_000])
    whole = index.build_index(df)
    for columns, fields in (((), ["counters"]), (["law_code"], ["counters", "chunks_by_law"]), (("domain_tags",), ["counters", "tag_counts"])):
        made = index.build_index(df, columns=columns)
        for field in fields:
            assert sorted(map(tuple, getattr(made, field).collect())) == sorted(map(tuple, getattr(whole, field).collect()))
        assert made.chunks.columns == ["record_pos", "article_idx", "part_idx", *columns]
        assert (made.chunks_by_law is None, made.tag_counts is None) == ("law_code" not in columns, "domain_tags" not in columns)
    runs = [held for name, held in written if name == "run"]
    assert {"text", "formatted_text"} <= runs[0] and all(not {"text", "formatted_text"} & held for held in runs[1:])
