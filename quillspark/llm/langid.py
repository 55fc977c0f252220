"""Language identification by Bayesian fusion of text, markup, address and host evidence.

log posterior = tempered log-likelihood of the text's character trigrams
              + log P(declared markup language | language) + log P(address language | language)
              + log prior of the host, smoothed towards its domain and that towards the whole corpus.

Trigram models are fitted on a bounded sample of labelled rows. The two conditional tables and the host
priors are grouped counts over all rows, each row counted by the language that its text alone suggests; for
the posterior of a row its own count is left out of all of them. All pages of a document speak for it, each by
its share: declarations are averaged over the pages, and the prior is the mean of their hosts' priors.
A class of its own ("und", uniform over trigrams) takes texts that no model explains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import spread_join, staged, thinned, trimmed

#: Labelled rows (about) that the models are fitted on, those whose id and text hash lowest.
SAMPLE = 2000
BUCKETS = 1 << 15
#: Overlapping trigrams repeat each other's evidence: each counts for a third.
TEMPER = 1 / 3
UND = "und"
#: Weight of the parent's prior at each level of the host hierarchy.
SMOOTHING = 10.0
#: A language is accepted from this posterior on.
ACCEPT = 0.5
#: Country suffixes whose language has another code (fixed values).
SUFFIX_LANGUAGE = {"uk": "en", "us": "en", "at": "de", "mx": "es"}
#: Tables of at most so many hosts are broadcast; with more, hosts are joined by salted keys.
BROADCAST_HOSTS = 5_000
SCORES = "uid long, doc_id long, row_key long, source string, ll array<double>, n_trigrams long, guess int"
FOUND = "doc_id long, row_key long, lang string, confidence double, accepted boolean, text_lang string, n_trigrams long"

_letters: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased text; other than letters count as one blank between words."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x30000)), dtype=bool, count=0x30000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where((c < 0x30000) & _letters[0][np.minimum(c, 0x2FFFF)], c, 32).astype(np.uint32)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    blank = c == 32
    c = c[~(blank & np.r_[False, blank[:-1]])]
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1)):
            total.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
            total[label] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()])], names=["label", "counts"])


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages with "und" at the end, and log P(trigram | language) by row."""
    rows = df.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("string").alias("id"))
    total: dict[str, np.ndarray] = {}
    for r in thinned(rows, sample, "id", "text").select("label", "text").mapInArrow(trimmed(_counts), "label string, counts binary").collect():
        v = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64)
        total[r["label"]] = total.get(r["label"], 0) + v
    langs = sorted(total)
    table = [np.log((total[x] + 0.1) / (total[x].sum() + 0.1 * BUCKETS)) for x in langs]
    return [*langs, UND], np.array([*table, np.full(BUCKETS, -np.log(BUCKETS))], dtype=np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = model.value, TaskContext.get().partitionId() << 36
        for b in batches:
            ll, n = np.zeros((b.num_rows, len(table))), np.zeros(b.num_rows, dtype=np.int64)
            for k, text in enumerate(b.column(3)):
                t = trigrams(text.as_py() or "")
                n[k] = len(t)
                if len(t):
                    ll[k] = table[:, t].sum(axis=1, dtype=np.float64) * TEMPER
            guess = np.where(n > 0, ll.argmax(axis=1), len(table) - 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, len(table)), pa.int32()), pa.array(ll.ravel()))
            cols = [pa.array(np.arange(uid, uid + b.num_rows)), *(b.column(c) for c in range(3)), lists, pa.array(n), pa.array(guess)]
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def address_language(address: Column) -> tuple[Column, Column]:
    """(host, language code) of an address: a two-letter path segment comes first, else the suffix of the host."""
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)", 1))
    segment = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]+/(?:[^?#]*/)?([a-zA-Z]{2})(?:/|$|[?#])", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    for code, lang in SUFFIX_LANGUAGE.items():
        suffix = F.when(suffix == code, lang).otherwise(suffix)
    return host, F.when(segment != "", segment).otherwise(suffix)


def domain_of(host: Column) -> Column:
    """The last two labels of a host; other names are their own domain."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, markup, address: a row for each page that names a document in its address."""
    head = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    doc = F.expr(r"try_cast(regexp_extract(url, '/[a-zA-Z]{2}/([0-9]+)', 1) as bigint)")
    return pages.select(doc.alias("doc_id"), head.alias("markup"), F.col("url").alias("address")).filter("doc_id is not null")


def _shares(code: str, n: int) -> Column:
    """The share of a document's pages that declare each language (entry k - 1: language k)."""
    every = F.sum("pages")
    return F.array(*(F.sum(F.when(F.col(code) == k, F.col("pages")).otherwise(0)) / every for k in range(1, n)))


def _votes(n: int) -> Column:
    """Rows by the language that their text suggests."""
    return F.array(*(F.count(F.when(F.col("guess") == k, 1)) for k in range(n)))


def _with_prior(incidences: DataFrame, overall: list[int], n: int) -> DataFrame:
    """uid, prior: the mean over a row's hosts of priors that leave out the row itself.

    ``incidences`` has a row for each row and host of it: uid, guess, host, domain, pages.
    """
    hosts = incidences.groupBy("host", "domain").agg(_votes(n).alias("in_host"))
    domains = incidences.select("uid", "guess", "domain").distinct().groupBy("domain").agg(_votes(n).alias("in_domain"))
    table = staged(hosts.join(domains, "domain").drop("domain"), "hosts")
    met = spread_join(incidences, table, "host", "uid", most=BROADCAST_HOSTS)
    own = [F.when(F.col("guess") == k, 1).otherwise(0) for k in range(n)]
    total = sum(overall)
    met = met.withColumn("p", F.array(*((F.lit(overall[k]) - own[k] + 1) / F.lit(total - 1 + n) for k in range(n))))
    for level in ("in_domain", "in_host"):
        rows = F.aggregate(level, F.lit(0).cast("long"), lambda a, x: a + x) - 1
        met = met.withColumn("p", F.array(*((F.col(level)[k] - own[k] + SMOOTHING * F.col("p")[k]) / (rows + SMOOTHING) for k in range(n))))
    mean = F.array(*(F.sum(F.col("p")[k] * F.col("pages")) / F.sum("pages") for k in range(n)))
    return met.groupBy("uid").agg(mean.alias("prior"))


def declared(counts: np.ndarray, shares: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """log P(declarations of each row | language), by row and language, without what the row added to ``counts``.

    counts[e, l]: declarations of e on rows of language l; shares[i, e]: those of row i, whose language was guess[i].
    """
    n = counts.shape[1]
    own = np.zeros((len(shares), *counts.shape))
    own[np.arange(len(shares)), :, guess] = shares
    left = np.maximum(counts - own, 0.0) + 0.5
    return np.einsum("ie,iel->il", shares, np.log(left / left.sum(axis=1, keepdims=True))) if len(counts) else np.zeros((len(shares), n))


def _fuse(langs: list[str], markup: np.ndarray, address: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = len(langs), np.array(langs, dtype=object)
        grid = lambda c, width: c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), width)
        for b in batches:
            guess, trigram = b.column("guess").to_numpy(), b.column("n_trigrams").to_numpy()
            score = grid(b.column("ll"), n) + np.log(grid(b.column("prior"), n))
            score += declared(markup, grid(b.column("markup"), n - 1), guess) + declared(address, grid(b.column("address"), n - 1), guess)
            post = np.exp(score - score.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            best = np.where(trigram > 0, post.argmax(axis=1), n - 1)
            sure = post[np.arange(len(best)), best]
            ok = (best < n - 1) & (sure >= ACCEPT)
            cols = [b.column("doc_id"), b.column("row_key"), pa.array(names[best], pa.string()), pa.array(sure), pa.array(ok), pa.array(names[guess], pa.string()), b.column("n_trigrams")]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def identify(
    df: DataFrame,
    evidence: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    source_col: str = "source",
    sample: int = SAMPLE,
    key_col: str | None = None,
) -> DataFrame:
    """One row for each input row: doc_id, lang, confidence, accepted, text_lang, n_trigrams (and row_key with ``key_col``).

    ``evidence`` may give markup and address of the pages of some ids (any number each); elsewhere the source
    stands for the host and the other two say nothing. A null or empty text, or one without letters, is "und"
    and not accepted, as is every row when no row has a label. Null evidence says nothing and null ids have none;
    rows that repeat an id share its evidence and count each; an empty table gives an empty result; other columns
    are ignored. ``key_col`` names a long column that is handed on.
    """
    spark = df.sparkSession
    langs, table = fit(df, id_col, text_col, label_col, sample)
    model = spark.sparkContext.broadcast(table)
    n = len(langs)
    key = F.col(key_col) if key_col else F.lit(None).cast("long")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key.alias("row_key"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = staged(rows.mapInArrow(trimmed(_score(model)), SCORES), "scores")
    none = F.array_repeat(F.lit(0.0), n - 1)
    own_host = F.coalesce("source", F.lit(""))
    if evidence is None:
        incidences = scored.select("uid", "guess", own_host.alias("host"), F.lit(1).alias("pages"))
        known = scored.withColumn("markup", none).withColumn("address", none)
    else:
        codes = F.array(*(F.lit(x) for x in langs[:-1])) if n > 1 else F.array().cast("array<string>")
        index = lambda c: F.coalesce(F.array_position(codes, c), F.lit(0)).cast("int")
        host, code = address_language(F.col("address"))
        pages = evidence.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), index(F.substring("markup", 1, 2)).alias("m"), index(code).alias("a"), F.coalesce(host, F.lit("")).alias("host"))
        pages = pages.groupBy("doc_id", "host", "m", "a").agg(F.count(F.lit(1)).alias("pages"))
        by_host = pages.groupBy("doc_id", "host").agg(F.sum("pages").alias("pages"))
        incidences = scored.select("uid", "doc_id", "guess", own_host.alias("own")).join(by_host, "doc_id", "left")
        incidences = incidences.select("uid", "guess", F.coalesce("host", "own").alias("host"), F.coalesce("pages", F.lit(1)).alias("pages"))
        shares = pages.groupBy("doc_id").agg(_shares("m", n).alias("markup"), _shares("a", n).alias("address"))
        known = scored.join(shares, "doc_id", "left").withColumn("markup", F.coalesce("markup", none)).withColumn("address", F.coalesce("address", none))
    known = known.drop("source")
    sums = lambda c: F.array(*(F.sum(F.col(c)[e]) for e in range(n - 1))).cast("array<double>")
    counts = np.zeros((2, n - 1, n))
    overall = [0] * n
    for r in known.groupBy("guess").agg(F.count(F.lit(1)).alias("rows"), sums("markup").alias("m"), sums("address").alias("a")).collect():
        counts[0, :, r["guess"]], counts[1, :, r["guess"]], overall[r["guess"]] = r["m"], r["a"], r["rows"]
    incidences = staged(incidences.withColumn("domain", domain_of(F.col("host"))), "incidences")
    fused = known.join(_with_prior(incidences, overall, n), "uid").mapInArrow(trimmed(_fuse(langs, *counts)), FOUND)
    return fused if key_col else fused.drop("row_key")
