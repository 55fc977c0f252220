import compare
import pytest

from quillspark import catalog

ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, sf, con, name):
    assert compare.rows_of(catalog.QUERIES[name](spark, sf)) == compare.oracle_rows(con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_split_and_pack_queries_have_the_properties_of_cuts(spark, sf):
    from plain import check_packs, check_parts, tidy

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for query in ("split_long_text", "pack_units"):
        got = {}
        for r in catalog.QUERIES[query](spark, sf).orderBy("doc_id", "part").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        for k, text in docs.items():
            if query == "split_long_text":
                check_parts(tidy(text), got[k], 1500)
            else:
                check_packs(text.split("\n"), got.get(k, []), 1500)


@pytest.mark.parametrize("name", ["article_segments", "index_chunks", "index_counters", "chunks_by_law", "chunks_by_tag"])
def test_lines_that_are_headings_count_alike_in_sql(spark, tmp_path, name):
    """Invented prose has lines such as "Osmi del ...", which the rules of the acts read as headings."""
    odd = ["Osmi del doque bo", "osmi delček je", "IV. SPLOŠNE DOLOČBE", "3. oddelek", "7. Naslov brez pike", "7. Naslov s piko.", "(1) v oklepaju)", "( naslov )", "", "That Einv cióne éleau ouel shing the und"]
    texts = ["\n".join(["a"] * k + odd + [f"b{k} " * 600] * 12 + odd[:1]) for k in range(9)]
    spark.createDataFrame([(k, x, "de", f"src{k % 4}", len(x)) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = compare.rows_of(catalog.QUERIES[name](spark, str(tmp_path)))
    assert got == compare.oracle_rows(compare.connect(str(tmp_path)), catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["ndcg_at_k", "ndcg_summary", "compare_metrics"])
def test_scores_half_way_between_hundredths_tie_alike_in_sql(spark, tmp_path, name):
    """A cosine distance of 0.565 (or a squared distance of 1.005) has a hundredfold just below the half."""
    distances = [0.0, 0.565, 0.567, 0.563, 0.5025, 0.5045, 0.5005, 0.575, 0.285, 0.289]
    rows = [(k, [1 - x, (1 - (1 - x) ** 2) ** 0.5], k * 7 % 10) for k, x in enumerate(distances)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = compare.rows_of(catalog.QUERIES[name](spark, str(tmp_path)))
    assert got == compare.oracle_rows(compare.connect(str(tmp_path)), catalog.ORACLES[name])
