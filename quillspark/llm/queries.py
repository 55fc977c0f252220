"""The queries of this subpackage and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat, collocations, exact_dedup, html_extract, langid, lm_score, merkle, mixing, ngram_join, packing, pieces, pii, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as good and not toxic, the background are all."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), with_position=True).drop("rate")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), langid.page_evidence(table(spark, sf_dir, "pages")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all documents; some are checked with a character count that is one too high."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    forged = [F.col("n_chars") + 1 if k == 3 else c for k, c in enumerate(fields)]
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest(*forged))
    made = merkle.manifest(table(spark, sf_dir, "documents"), merkle.leaf_digest(*fields), shown)
    proof = merkle.digest(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""))
    return made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_lm_scoring,
        op3_pii,
        op4_ngram_join,
        op5_best_fit_packing,
        op6_chat_formatting,
        op7_mixing,
        op8_topk,
        op9_language_id,
        op10_exact_dedup,
        op11_sentencepiece,
        op12_merkle_manifest,
        op13_collocations,
    )
}

ORACLES: dict[str, str] = {
    "op4_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                 lambda x: x <> '') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                 ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
    """,
    "op6_chat_formatting": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                     string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>', chr(10)) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(31) || text))),
        whole AS (SELECT so_far, n_turns, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE place = n_turns GROUP BY so_far, n_turns)
        SELECT conv_id, n_turns::INTEGER AS n_turns, n_logged, so_far || chr(10) AS rendered FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = whole.n_turns AND p.place < p.n_turns AND p.so_far = whole.so_far)
    """,
    "op7_mixing": """
        WITH v AS (SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')))::DOUBLE AS volume FROM documents GROUP BY 1),
        r AS (SELECT s, CASE WHEN volume > 0 THEN pow(volume, 0.7) / sum(CASE WHEN volume > 0 THEN pow(volume, 0.7) ELSE 0 END) OVER ()
                             * sum(volume) OVER () / volume ELSE 1.0 END AS rate FROM v),
        terms AS (SELECT s, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM r, generate_series(0, 100) AS g(k)),
        cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
        u AS (SELECT *, coalesce(source, '') AS s,
                     (('0x' || substr(md5('mix-1:n:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS x FROM documents),
        n AS (SELECT doc_id, count(*) AS n_copies FROM u JOIN cdf ON u.s = cdf.s AND cdf.c < u.x GROUP BY doc_id)
        SELECT d.*, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies, md5('mix-1:at:' || d.doc_id || ':' || copy) AS order_key
        FROM documents d JOIN n USING (doc_id), LATERAL (SELECT unnest(range(n_copies)) AS copy)
    """,
    "op8_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT r, vec_id, list_transform(e, lambda x: floor(64 * x)::HUGEINT) AS e FROM v),
        s AS (SELECT a.r AS own, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.r <> b.r),
        o AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM o WHERE rank <= 20
    """,
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id NULLS LAST)
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (SELECT *, coalesce('=' || lang, '-') AS g, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                 range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)), lambda c, b: list_reduce(
                 list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
        said AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                 coalesce(strlen(text) || ':' || text, '-') AS tail FROM f),
        l AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos,
                 sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                 sha256(head || coalesce(strlen((n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' ||
                                         (n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS shown FROM said),
        t(g, k, pos, d, m) AS (SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM l UNION ALL
                 SELECT g, any_value(k) + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(m) + 1) // 2 FROM t WHERE m > 1 GROUP BY g, pos // 2),
        s AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos FROM t WHERE m = 1),
        u(k, pos, d, m) AS (SELECT 0, pos, d, count(*) OVER () FROM s UNION ALL
                 SELECT any_value(k) + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(m) + 1) // 2 FROM u WHERE m > 1 GROUP BY pos // 2),
        up AS (SELECT g, k, pos, d, m FROM t UNION ALL SELECT '', k, pos, d, m FROM u),
        h AS (SELECT g, max(k) AS tall FROM t GROUP BY g),
        steps AS (SELECT g, k AS step, g AS of, k FROM h, LATERAL (SELECT unnest(range(tall)) AS k)
                  UNION ALL SELECT g, tall + k, '', k FROM h, LATERAL (SELECT unnest(range((SELECT max(k) FROM u))) AS k)),
        placed AS (SELECT l.g, doc_id, l.pos AS own, step, CASE WHEN of = '' THEN s.pos ELSE l.pos END // (1 << k) AS at, of, k
                   FROM l JOIN steps USING (g) JOIN s USING (g)),
        beside AS (SELECT p.g, p.own, p.step, p.at, up.d AS other FROM placed p LEFT JOIN up ON up.g = p.of AND up.k = p.k AND up.pos = xor(p.at, 1)),
        fold(g, own, step, d) AS (SELECT g, pos, 0, shown FROM l UNION ALL
                 SELECT f.g, f.own, f.step + 1, sha256(CASE WHEN b.at % 2 = 0 THEN f.d || coalesce(b.other, '') ELSE coalesce(b.other, '') || f.d END)
                 FROM fold f JOIN beside b ON b.g = f.g AND b.own = f.own AND b.step = f.step),
        proof AS (SELECT g, own, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS p FROM beside GROUP BY g, own),
        ended AS (SELECT g, own, max_by(d, step) AS d FROM fold GROUP BY g, own),
        r AS (SELECT d AS root FROM u WHERE m = 1)
        SELECT doc_id, leaf, s.d AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, e.d AS folded_root, e.d = root AS verified
        FROM l JOIN s USING (g) CROSS JOIN r JOIN ended e ON e.g = l.g AND e.own = l.pos LEFT JOIN proof ON proof.g = l.g AND proof.own = l.pos
    """,
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, z, unnest(list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' '))) AS gram FROM w, range(1, 4) AS s(z)),
        f AS (SELECT lang, z, gram, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE z = 1 GROUP BY lang),
        c AS (SELECT *, string_split(gram, ' ') AS w FROM f WHERE z > 1 AND f >= 10),
        cuts AS (SELECT lang, z, gram, w, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, 3) AS s(k) WHERE k < z),
        s AS (SELECT cuts.*, p.f AS l, q.f AS r, 1000000 * a * a // (p.f * q.f) AS score FROM cuts
              JOIN f p ON p.lang = cuts.lang AND p.gram = x JOIN f q ON q.lang = cuts.lang AND q.gram = y),
        b AS (SELECT lang, z, gram, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
        inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS gram, max(f) AS longer FROM c, range(1, 3) AS s(i) WHERE z = 3 GROUP BY ALL),
        kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, gram) WHERE longer IS NULL OR 100 * longer < 50 * a),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM kept)
        SELECT lang, rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
    """,
}
