import pytest

#: Rows with everything that may go wrong: nulls, blanks, repeats, ties, a very long text, odd characters.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def long_text() -> str:
    return " ".join(f"{WORDS[i % 20]}{i * 7919 % 1013}" for i in range(60_000))


def odd_rows():
    base = " ".join(f"{w} {w}s {w}ed" for w in WORDS)
    return [
        (1, base, "en", "a", "x"),
        (2, base.upper(), "en", "a", "y"),
        (3, base.replace(" ", "\t\n "), "en", "b", None),
        (3, base.replace(" ", "\t\n "), "en", "b", None),
        (4, base + " tail", "de", "b", "z"),
        (5, None, None, None, None),
        (6, "", "en", "a", ""),
        (7, " \n\t ", "en", "a", ""),
        (8, "one two", "en", "c", ""),
        (9, "one two", "en", "c", ""),
        (10, long_text(), "en", "c", ""),
        (11, "élan 😀 漢字   x\x1cy <|endoftext|> end", "fr", "c", ""),
        (None, "no id here at all", "en", "a", ""),
        (12, base.replace("omicron", "omega"), "en", "a", ""),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, `Copy` string"
    return spark.createDataFrame(odd_rows(), schema).withColumnRenamed("Copy", "uid").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, uid string")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(4).cache()


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    """Few tasks for small tables."""
    from quillspark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LEAST_RANGES", 8)
