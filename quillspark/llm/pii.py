"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their values are the protected
entities. The terms of a text that holds an entity co-occur with it; over the corpus the strength of that is

    disclosure(e, t) = PMI(e; t) / IC(e),   PMI = log(p(e | t) / p(e)),   IC(e) = -log p(e),

which is 1 where t implies e and about 0 where t is unrelated. p(e) and p(e | t) count documents over the
whole corpus, words outside the patterns' spans alike for both; p(e | t) is drawn towards p(e) by some documents'
worth. An e-mail address stands for its domain too, so that what gives an organisation away counts as well. A term
at or above a threshold, seen with the entity in at least two documents of different text (copies are one) and
more often than chance would do for any of the corpus' terms, is added as a span of kind "term" wherever it
stands in the corpus, with the entity or without.

Pairs are made sparingly, and none is left out. Entities of the very same documents are alike for every term, so one
stands for all of them; so does one term for those of the same documents. What two documents must show is
never paired in the largest document of an entity: the others name the candidates, which are then looked up
there. A directory of very many addresses costs its length, not its square. Generalising a text replaces its spans by the name of their kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import counted_join, fresh, keyed, spread_join, staged, trimmed
from quillspark.llm.passing import Passing

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information that a term may give away, and the different texts that must agree.
THRESHOLD, SUPPORT = 0.8, 2
#: Documents' worth of the entity's overall share in the estimate of p(e | t).
SMOOTHING = 0.5
#: Terms shorter than this are function words or fragments.
SHORTEST = 3

#: Keys looked up exactly (4 MB); more go through a filter, which lets some others by.
EXACT_KEYS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|*&#%$"
SCHEMA = "uid long, doc_id long, row_key long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, found array<struct<term:long,start:long,stop:long>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards so that long runs cost no retries."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """A dotted run of numbers gives a match for each four of its parts."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four patterns by kind, then start, in code points."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *s) for s in _addresses(text)]
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _signed(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def term_of(word: str) -> str:
    return word.strip(_EDGE).lower()


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """Hashes of the different values found, and of the domains of addresses."""
    values = [(k, text[a:b].lower() if k == "email" else text[a:b] if k == "ip" else _digits(text[a:b])) for k, a, b in spans]
    values += [("domain", v.rpartition("@")[2]) for k, v in values if k == "email"]
    return [_signed(f"{k}:{v}".encode()) for k, v in dict.fromkeys(values)]


def text_hash(text: str) -> int:
    """Equal for texts of the same words."""
    return _signed(" ".join(text.split()).encode("utf-8", "surrogatepass"))


def body_hash(text: str) -> int:
    """Equal for equal texts, which have the same entities and terms."""
    return _signed(text.encode("utf-8", "surrogatepass"))


class _Terms(dict):
    """Term hashes of raw words (0 for none), dropped when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        t = term_of(word)
        h = self[word] = _signed(t.encode("utf-8", "surrogatepass")) if len(t) >= SHORTEST else 0
        return h


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The words of ``text`` that touch no span."""
    if not spans:
        return _WORD.findall(text)
    matches = list(_WORD.finditer(text))
    starts, stops = [m.start() for m in matches], [m.end() for m in matches]
    taken: set[int] = set()
    for _, a, b in spans:
        taken.update(range(bisect_right(stops, a), bisect_left(starts, b)))
    return [m[0] for k, m in enumerate(matches) if k not in taken]


def _distinct(words: list[str], terms: _Terms) -> np.ndarray:
    """Hashes of the different terms among ``words``."""
    once = set(words)
    h = np.unique(np.fromiter(map(terms.__getitem__, once), dtype=np.int64, count=len(once)))
    return h[h != 0]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, text hash and hash of the bare text for each document and entity in it."""
    for b in batches:
        entity, where, body = [], [], []
        for value in b.column(0):
            text = value.as_py() or ""
            if spans := base_spans(text):
                held = entities_of(text, spans)
                entity += held
                where += [text_hash(text)] * len(held)
                body += [body_hash(text)] * len(held)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (entity, where, body)], names=["entity", "place", "body"])


def _together(passing: _Among):
    """Both hashes, entities that may pass and all terms of each document that has such entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for b in batches:
            rows = []
            for value in b.column(0):
                text = value.as_py() or ""
                if spans := base_spans(text):
                    held = np.array(entities_of(text, spans), dtype=np.int64)
                    held = held[passing(held)]
                    if len(held):
                        rows.append((text_hash(text), body_hash(text), held, _distinct(words_outside(text, spans), terms)))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["place", "body", "entities", "terms"])

    return run


def _narrowed(passing: _Among):
    """The documents of ``_together``, numbered, with the terms that may pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 36
        for b in batches:
            terms = [x.values.to_numpy() for x in b.column(2)]
            terms = pa.array([t[passing(t)] for t in terms], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(doc, doc + len(b))), b.column(0), b.column(1), terms], names=["doc", "place", "entities", "terms"])
            doc += len(b)

    return run


def _document_counts(passing: _Among):
    """Documents of each term that may pass; a task hands its counts on when they are many, and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, size = _Terms(), [], 0

        def counted() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64))], names=["term", "n"])

        for b in batches:
            found = []
            for value in b.column(0):
                text = value.as_py() or ""
                h = _distinct(_WORD.findall(text), terms)
                h = h[passing(h)]
                # Spans only take terms away, so texts without a hit need no search for them.
                if len(h) and (spans := base_spans(text)):
                    h = np.intersect1d(h, _distinct(words_outside(text, spans), terms), assume_unique=True)
                found.append(h)
            if found:
                held.append(np.unique(np.concatenate(found), return_counts=True))
                size += len(held[-1][0])
            if size > 4 * EXACT_KEYS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return run


_FOUND = pa.list_(pa.struct([(n, pa.int64()) for n in ("term", "start", "stop")]))


def _find(passing: _Among):
    """The base spans of each text, and all places of terms that may pass."""

    def places(text: str, spans: list[tuple[str, int, int]], terms: _Terms) -> list[dict]:
        h = _distinct(_WORD.findall(text), terms)
        wanted = set(h[passing(h)].tolist())
        if not wanted:
            return []
        matches = list(_WORD.finditer(text))
        starts, stops = [m.start() for m in matches], [m.end() for m in matches]
        taken: set[int] = set()
        for _, a, b in spans:
            taken.update(range(bisect_right(stops, a), bisect_left(starts, b)))
        out = []
        for k, m in enumerate(matches):
            if k not in taken and (term := terms[m[0]]) in wanted:
                bare = m[0].strip(_EDGE)
                start = m.start() + m[0].index(bare)
                out.append({"term": term, "start": start, "stop": start + len(bare)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        terms = _Terms()
        for b in batches:
            rows = []
            for doc_id, value, key in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = value.as_py() or ""
                spans = base_spans(text)
                n = Counter(k for k, _, _ in spans)
                base = _joined(spans)
                rows.append((uid, doc_id, key, *(n[k] for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(), places(text, spans, terms)))
                uid += 1
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 7 + [pa.string(), pa.string(), _FOUND]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


class _Among:
    """Which hashes are among ``keys`` (one long column): exact for few keys, by a filter for many, where joins decide."""

    def __init__(self, keys: DataFrame) -> None:
        self.held, self.passing = None, None
        if keys.count() <= EXACT_KEYS:
            values = np.sort(keys.toArrow().column(0).to_numpy().astype(np.int64))
            self.held = keys.sparkSession.sparkContext.broadcast(values)
        else:
            self.passing = Passing(keys)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.passing is not None:
            return self.passing(h)
        values = self.held.value
        if not len(values):
            return np.zeros(len(h), dtype=bool)
        return values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h


def _supported(df: DataFrame, keys: list[str], support: int, count: str) -> DataFrame:
    """``keys`` seen at ``support`` different places (text hashes) or more, with the number of their documents."""
    n = F.count(F.lit(1)).alias(count)
    if support <= 2:  # two places differ exactly when the least and the greatest do
        out = df.groupBy(*keys).agg(n, F.min("place").alias("p0"), F.max("place").alias("p1"))
        return out.filter("p0 <> p1" if support == 2 else "true").select(*keys, count)
    by_place = df.groupBy(*keys, "place").agg(F.count(F.lit(1)).alias("n"))
    out = by_place.groupBy(*keys).agg(F.sum("n").alias(count), F.count(F.lit(1)).alias("places"))
    return out.filter(F.col("places") >= support).select(*keys, count)


#: What tells apart the documents of two keys: their number, the least and the greatest text, the sum of the texts' hashes.
DOCUMENTS = ("n_docs", "p0", "p1", "bodies")


def _documents(df: DataFrame, key: str) -> DataFrame:
    """``key`` with its ``DOCUMENTS``; ``df`` has a row for each document and key in it."""
    n = F.count(F.lit(1)).alias("n_docs")
    return df.groupBy(key).agg(n, F.min("place").alias("p0"), F.max("place").alias("p1"), F.sum(F.col("body").cast("decimal(20,0)")).alias("bodies"))


def _leads(df: DataFrame, key: str) -> DataFrame:
    """The least of the keys of the very same documents, for each such set of documents."""
    return df.groupBy(*DOCUMENTS).agg(F.min(key).alias(key))


def _pairs(docs: DataFrame, support: int) -> DataFrame:
    """entity, term, place of all pairs that may be seen at ``support`` places; ``docs`` are numbered and stored.

    A pair of two documents is in another document than the largest of its entity: those name it, and are few.
    """
    if support < 2:
        return docs.select("place", "terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term"), "place")
    weight = F.size("entities").cast("long") * F.size("terms")
    each = docs.select("doc", F.explode("entities").alias("entity"), F.struct(weight.alias("weight"), "doc", "place").alias("home"))
    homes = staged(each.groupBy("entity").agg(F.max("home").alias("home")), "homes")
    away = spread_join(each.select("doc", "entity"), homes, "entity", "doc").filter("doc <> home.doc")
    away = staged(away.select("doc", "entity", F.col("home.doc").alias("home_doc"), F.col("home.place").alias("home_place")), "away")
    named = away.join(docs.select("doc", "place", "terms"), "doc").select("entity", F.explode("terms").alias("term"), "place", "home_doc", "home_place")
    wanted = named.groupBy("entity", "term").agg(F.min("home_doc").alias("doc"), F.min("home_place").alias("place"))
    at_home = wanted.join(docs.select("doc", F.explode("terms").alias("term")), ["doc", "term"])
    return named.select("entity", "term", "place").unionByName(at_home.select("entity", "term", "place"))


def disclosure(n_both: Column, n_term: Column, n_entity: Column, n_docs: int, smoothing: float) -> Column:
    """PMI(e; t) / IC(e); 0 for an entity that all documents have."""
    p = n_entity / F.lit(float(n_docs))
    given = (n_both + smoothing * p) / (n_term + smoothing)
    return F.when(p < 1, F.log(given / p) / -F.log(p)).otherwise(F.lit(0.0))


def disclosing_terms(texts: DataFrame, threshold: float, support: int, smoothing: float) -> DataFrame:
    """The hashes of the terms of ``texts`` (one column) that give an entity away."""
    n_docs = max(2, texts.count())
    # An entity of fewer different texts than the support has no term that reaches it.
    held = texts.mapInArrow(trimmed(_entities), "entity long, place long, body long")
    entities = _documents(held, "entity").filter("p0 <> p1" if support > 1 else "true")
    if support > 2:
        entities = entities.join(_supported(held, ["entity"], support, "n").select("entity"), "entity", "left_semi")
    entities = staged(_leads(entities, "entity").select("entity", F.col("n_docs").alias("n_entity")), "entities")
    together = staged(texts.mapInArrow(trimmed(_together(_Among(entities.select("entity")))), "place long, body long, entities array<long>, terms array<long>"), "together")
    # The documents with entities alone bound a term's share from above: what falls below the threshold there needs no count.
    seen = staged(_documents(together.select("place", "body", F.explode("terms").alias("term")), "term"), "seen")
    n_terms = seen.count()
    told = lambda n_term: disclosure(F.col("n_both"), F.col(n_term), F.col("n_entity"), n_docs, smoothing) >= threshold
    chance = F.col("n_both") * -F.log(F.col("n_entity") / F.lit(float(n_docs))) > float(np.log(max(1, n_terms)))
    leads = staged(_leads(seen.filter("p0 <> p1" if support > 1 else "true"), "term"), "leads")
    docs = staged(together.drop("body").mapInArrow(trimmed(_narrowed(_Among(leads.select("term")))), "doc long, place long, entities array<long>, terms array<long>"), "narrowed")
    # One lead of a term may meet entities without number; leads of many documents are spread.
    pairs = spread_join(_supported(_pairs(docs, support), ["entity", "term"], support, "n_both"), entities, "entity", "term").filter(chance)
    pairs = counted_join(staged(pairs, "likely"), leads.withColumn("n_seen", F.col("n_docs")), ["term"], "entity", "n_seen")
    pairs = pairs.filter(told("n_seen"))
    pairs = staged(pairs.withColumnRenamed("term", "lead").join(seen, list(DOCUMENTS)), "pairs")
    passing = _Among(pairs.select("term").distinct())
    in_corpus = texts.mapInArrow(trimmed(_document_counts(passing)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return pairs.join(in_corpus, "term").filter(told("n_term")).select("term").distinct()


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT, smoothing: float = SMOOTHING, key_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term (and row_key with ``key_col``).

    ``spans`` lists kind:start:end, the base kinds in their order and then "term", each by start. A null text
    counts as empty; repeated rows are found alike and count as documents of their own, though their
    text is one; null ids are carried; an empty table gives an empty result; other columns are ignored.
    ``key_col`` names a long column that is handed on.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    disclosing = staged(disclosing_terms(df.select(text), threshold, support, smoothing), "disclosing")
    key = F.col(key_col) if key_col else F.lit(None).cast("long")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text, key.alias("row_key"))
    found = staged(rows.mapInArrow(trimmed(_find(_Among(disclosing))), SCHEMA), "spans")
    hits = found.filter(F.size("found") > 0).select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    hits = spread_join(hits, disclosing, "term", "uid")
    each = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("terms"))
    out = found.drop("found").join(each, "uid", "left")
    added = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["stop"].cast("string"))), ",")
    return out.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), added).alias("spans"),
        F.coalesce(F.size("terms").cast("long"), F.lit(0).cast("long")).alias("n_term"),
        *(["row_key"] if key_col else []),
    )


def sanitised(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in cuts:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with the text of each row generalised, all columns kept.

    Rows are told apart by a key of their own, so repeated and null ids are as good as others. A null text stays null.
    """
    generalise = F.pandas_udf(lambda t, x: t.combine(x, lambda a, b: None if a is None else sanitised(a, b or "")), "string")
    table, key = keyed(df, id_col)
    name, own = fresh(table, "__spans"), fresh(table, "__span_key")
    found = find_personal_data(table, id_col, text_col, key_col=key, **options).select(F.col("row_key").alias(own), F.col("spans").alias(name)).filter(F.col(name) != "")
    out = table.join(found, F.col(key) == F.col(own), "left")
    text = F.col(f"`{text_col}`")
    return out.withColumn(text_col, F.when(F.col(name).isNull(), text).otherwise(generalise(text, F.col(name)))).select(*(F.col(f"`{c}`") for c in df.columns))
