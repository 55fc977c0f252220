"""Main-text extraction by wrapper induction over the pages of a host.

Pages of one host come from one generator. Each page becomes a condensed tree (runs of like siblings are
one repeated node); trees are aligned by simple tree matching and merged into the host's template, node by
node. A second pass aligns every page with its host's template and counts, for each node, the pages that have each
text there. A text that nearly all pages have at a node is part of the template; what varies is a slot, and slots are content.

Extraction aligns a page with its host's template, drops lines that the page has in common with the template
and nodes whose role is not content (menus, headers, footers, side bars, notices, adverts, forms, comments)
and takes the main containers: all articles or main elements in page order, else the whole page, or without a template
the smallest element that holds most of the text. Where more than half of the containers' text is the template's, the host
repeats whole articles, and they keep it.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, spread_join, staged, trimmed
from quillspark.llm.dom import BLOCK, Node, attributes, parse

#: A text is constant from this share of at least so many pages on.
CONSTANT_SHARE, LEAST_PAGES = 0.8, 4
#: Templates of at most so many bytes together are broadcast; beyond that pages are joined with them.
BROADCAST_BYTES = 4_000_000
#: Hosts, and counts of texts, held by a task before it hands on what it has.
HOSTS_HELD, COUNTS_HELD = 2000, 500_000
#: A container is the main one if it holds this share of the text that is left.
MAIN_SHARE = 0.7
#: Containers that would lose more than this share of their text to the template are articles that the host repeats.
REPEATED_SHARE = 0.5

DROPPED_TAGS = frozenset("head title textarea noembed noframes script style noscript template iframe svg math canvas object embed audio video nav footer aside form button select textarea input dialog menu search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name a part other than content (fixed list).
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer sidebar aside rail widget widgets ad ads adv advert adverts advertisement "
    "adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing "
    "social related recommended recommendations comment comments commentlist disqus reply replies respond login signin search pagination pager copyright toolbar skip paywall".split()
)
#: Words that may stand beside those without changing what a name says (fixed list).
NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right upper lower header head primary secondary global local user users wp js id post posts article articles story stories news entry "
    "content body text inner outer wrap wrapper container box block bar area section panel region row col column group list item items link links icon icons button buttons btn "
    "title form field unit slot zone frame this more also sticky fixed float small large mobile desktop you us by of on for the to and".split()
)
#: Of those, words that tell such a part beside any other word, if it holds the smaller share of the text (fixed list).
TELLING_WORDS = frozenset("comment comments commentlist disqus cookie cookies gdpr consent newsletter subscribe signup paywall adsense advertisement sponsored breadcrumb breadcrumbs pagination".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that say what an element has or lacks, not what it is.
_ABOUT = re.compile(r"(?:has|have|with|without|no|not|is|hide|show)[-_]", re.I)
TEXT = "page_id long, url string, text string, n_chars long"


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def _holds_article(node: Node) -> bool:
    return any(isinstance(c, Node) and (c.tag in ("article", "main") or _holds_article(c)) for c in node.children)


class Whole:
    """The element that a part is judged within, with the size of its text once that is asked for."""

    __slots__ = ("node", "_size")

    def __init__(self, node: Node) -> None:
        self.node, self._size = node, -1

    @property
    def size(self) -> int:
        if self._size < 0:
            self._size = _length(self.node)
        return self._size


def _length(node: Node) -> int:
    return sum(len(c.strip()) if isinstance(c, str) else 0 if c.tag in ("script", "style", "head") else _length(c) for c in node.children)


def is_boilerplate(node: Node, inside: bool, whole: Whole | None = None, lenient: bool = False) -> bool:
    """By tag, role, class and id; ``inside`` an article its own header counts as content. ``lenient`` lets be what holds an article."""
    if node.tag in DROPPED_TAGS and not node.plain or node.tag == "header" and not inside:
        return not (lenient and node.tag in ("header", "aside") and _holds_article(node))
    if node.tag in ("html", "body", "#root", "main") or not node.raw:
        return False
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if a.get("role", "").lower() in DROPPED_ROLES:
        return not (lenient and _holds_article(node))
    names = [x for x in f"{a.get('class', '')} {a.get('id', '')}".split() if not _ABOUT.match(x)]
    if node.tag == "article":  # an article is what one of its whole names says
        return any(x.lower() in DROPPED_WORDS and not lenient or x.lower().startswith("comment") for x in names)
    dropped = DROPPED_WORDS if inside else DROPPED_WORDS | {"header"}
    if any(_names(x, dropped) for x in names):
        return not (lenient and _holds_article(node))
    if whole is not None and any(_tells_of(x) for x in names):
        return 2 * _length(node) < whole.size and not (lenient and _holds_article(node))
    return False


@lru_cache(maxsize=8192)
def _tells_of(name: str) -> bool:
    return any(w.lower() in TELLING_WORDS for w in _WORDS.findall(name))


@lru_cache(maxsize=8192)
def _names(name: str, dropped: frozenset) -> bool:
    """Whether all words of a name say such a part or nothing: "social-links" does, "social-science" does not."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & dropped) and words <= dropped | NEUTRAL_WORDS


def blocks_of(node: Node, inside: bool = False, use_marks: bool = False) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space collapsed, boilerplate left out.

    With ``use_marks`` a block goes if all its text is the template's; one that varies in part stays whole.
    """
    out: list[str] = []
    line: list[str] = []
    varies = False
    whole = Whole(node)

    def flush() -> None:
        nonlocal varies
        if line:
            text = " ".join("".join(line).split())
            if text and (varies or not use_marks):
                out.append(text)
            line.clear()
        varies = False

    def walk(n: Node, inside: bool) -> None:
        nonlocal varies
        for c in n.children:
            if isinstance(c, str):
                line.append(html.unescape(c) if "&" in c else c)
                varies = varies or n.mark != "template" and not c.isspace()
                continue
            if is_boilerplate(c, inside, whole):
                if c.tag in BLOCK:
                    flush()
                continue
            block = c.tag in BLOCK or c.tag == "br"
            if block:
                flush()
            walk(c, inside or c.tag in ("article", "main"))
            if block:
                flush()

    walk(node, inside or node.tag in ("article", "main"))
    flush()
    return out


class Slot:
    """A node of a condensed tree or template: label, constant texts (of a template), children, nodes (of a page).

    ``seen`` counts the pages that have the node, ``missed`` bounds those that had it before it was last pruned.
    """

    __slots__ = ("label", "texts", "children", "nodes", "seen", "missed")

    def __init__(self, label: str, texts: set[int] | None = None, children: list | None = None, nodes: list | None = None, seen: int = 1, missed: int = 0) -> None:
        self.label, self.texts, self.children, self.nodes, self.seen, self.missed = label, texts or set(), children or [], nodes or [], seen, missed

    def dump(self) -> list:
        return [self.label, sorted(self.texts), [c.dump() for c in self.children], self.seen, self.missed]

    @classmethod
    def load(cls, x: list) -> Slot:
        return cls(x[0], set(x[1]), [cls.load(c) for c in x[2]], None, x[3], x[4])


def matching(a: Slot, b: Slot, known: dict | None = None) -> int:
    """Simple tree matching: the most node pairs of two trees that keep labels, order and ancestry."""
    return 0 if a.label != b.label else 1 + _align(a.children, b.children, {} if known is None else known)[0]


def _align(a: list[Slot], b: list[Slot], known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best order-keeping pairing of two child lists, and its weight; ``known`` keeps it for whoever asks again."""
    if not a or not b:
        return 0, []
    key = id(a), id(b)
    if key not in known:
        known[key] = _aligned_lists(a, b, known)
    return known[key]


def _aligned_lists(a: list[Slot], b: list[Slot], known: dict) -> tuple[int, list[tuple[int, int]]]:
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b)):  # pairing all in order is best
        return sum(matching(x, y, known) for x, y in zip(a, b)), [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            row[j + 1] = max(above[j + 1], row[j], above[j] + matching(x, y, known) if x.label == y.label else 0)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def merge(a: Slot, b: Slot, known: dict | None = None, one_page: bool = False, late: tuple[int, int] = (0, 0)) -> Slot:
    """Two aligned trees as one; children without partner stay, in order. Parts of ``one_page`` count it once.

    ``late`` says how often nodes of a alone, and of b alone, may have been on pages of the other side that forgot them.
    """
    known = {} if known is None else known
    children, i, j = [], 0, 0
    for x, y in _align(a.children, b.children, known)[1] + [(len(a.children), len(b.children))]:
        children += [_late(c, late[0]) for c in a.children[i:x]] + [_late(c, late[1]) for c in b.children[j:y]]
        if x < len(a.children):
            children.append(merge(a.children[x], b.children[y], known, one_page, late))
        i, j = x + 1, y + 1
    return Slot(a.label, None, children, a.nodes + b.nodes, 1 if one_page else a.seen + b.seen, a.missed + b.missed)


def _late(node: Slot, pages: int) -> Slot:
    if pages:
        node.missed += pages
        for c in node.children:
            _late(c, pages)
    return node


#: Nodes that are on fewer than this share of a host's pages leave its template while it grows.
PRUNED_SHARE = 0.05


def grown(template: Slot, other: Slot) -> Slot:
    """A template with a page or another template merged into it, without nodes that are on few pages.

    A count is off by at most PRUNED_SHARE of the pages before the node last came in, so a node on more than that share
    of all pages always stays, and one that is not seen again soon goes: however many different nodes
    the pages have, 1 / PRUNED_SHARE times those of a page are held at most, and those of the last pages.
    """
    pages = template.seen + other.seen
    out = merge(template, other, None, False, (int(PRUNED_SHARE * other.seen) if other.seen > 1 else 0, int(PRUNED_SHARE * template.seen)))
    _prune(out, PRUNED_SHARE * pages)
    return out


def _prune(node: Slot, least: float) -> None:
    node.children = [c for c in node.children if c.seen + c.missed >= least]
    for c in node.children:
        _prune(c, least)


def _label(node: Node) -> str:
    return _labelled(node.tag, node.raw) if node.raw else node.tag


@lru_cache(maxsize=8192)
def _labelled(tag: str, raw: str) -> str:
    a = attributes(raw)
    # Words with digits inside are generated names; those at the end of a word are numbers.
    kept = lambda x: " ".join(re.sub(r"\d+$", "", w) for w in x.split() if not re.search(r"\d[^\d]", w))
    name = f"{kept(a.get('class', ''))}#{kept(a.get('id', ''))}"
    return f"{tag}.{name}" if name != "#" else tag


def _own_text(node: Node) -> int | None:
    """A hash of the text right below ``node``."""
    own = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
    return xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass")) - (1 << 63) if own else None


def condense(node: Node) -> Slot:
    """The tree of element nodes, neighbouring siblings of one label merged."""
    children: list[Slot] = []
    for c in node.children:
        if isinstance(c, Node) and c.tag not in ("script", "style", "head"):
            s = condense(c)
            if children and children[-1].label == s.label:
                children[-1] = merge(children[-1], s, one_page=True)
            else:
                children.append(s)
    return Slot(_label(node), None, children, [node])


def aligned(page: Slot, template: Slot, known: dict | None = None) -> Iterator[tuple[Slot, Slot]]:
    """Pairs of page and template nodes."""
    known = {} if known is None else known
    if page.label == template.label:
        yield page, template
        for i, j in _align(page.children, template.children, known)[1]:
            yield from aligned(page.children[i], template.children[j], known)


def mark(page: Slot, template: Slot) -> None:
    """Set the mark of page nodes whose own text is one that the template holds constant."""
    for own, node in aligned(page, template):
        if node.texts:
            for n in own.nodes:
                if _own_text(n) in node.texts:
                    n.mark = "template"


def texts_of(page: Slot, template: Slot) -> Iterator[tuple[Slot, set[int]]]:
    """The different texts that a page has at each template node, where it has some."""
    for own, node in aligned(page, template):
        if texts := {t for t in map(_own_text, own.nodes) if t is not None}:
            yield node, texts


def numbered(template: Slot) -> list[Slot]:
    """The nodes of a template in page order; a node's number is its place here."""
    out = [template]
    for c in template.children:
        out += numbered(c)
    return out


def _containers(node: Node, lenient: bool = False) -> list[Node]:
    """Topmost articles, else mains, that are not boilerplate themselves nor stand in it; ``lenient`` also those that do, but for comments."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    whole = Whole(node)

    def walk(n: Node, above: frozenset) -> None:
        for c in n.children:
            if not isinstance(c, Node) or is_boilerplate(c, False, whole, lenient):
                continue
            tag = "article" if c.tag == "article" or c.attrs.get("itemprop", "").lower() == "articlebody" else "main" if c.tag == "main" or c.attrs.get("role", "").lower() == "main" else ""
            if tag and tag not in above:
                found[tag].append(c)
            walk(c, above | {tag} if tag else above)

    walk(node, frozenset())
    return found["article"] or found["main"]


def _size(blocks: list[str]) -> int:
    return sum(map(len, blocks))


def main_text(root: Node, has_template: bool) -> str:
    """The text of a marked page; without a template to tell, the smallest element that holds most of the text is taken."""
    found = _containers(root)
    if not found and (hidden := _containers(root, lenient=True)):  # all stand in parts named like boilerplate: what the page is about, if they say more than the rest
        found = hidden if _size([x for c in hidden for x in blocks_of(c, inside=True)]) > _size(blocks_of(root)) else []
    held = [x for c in found for x in blocks_of(c, inside=True)]
    if held:
        varying = [x for c in found for x in blocks_of(c, inside=True, use_marks=True)]
        return "\n".join(varying if _size(varying) >= (1 - REPEATED_SHARE) * _size(held) else held)
    node = root
    blocks = blocks_of(node, use_marks=True)
    whole = _size(blocks)
    while whole and not has_template:
        down = None
        for c in node.children:
            if isinstance(c, Node) and c.tag in BLOCK and not is_boilerplate(c, False, Whole(node)):
                b = blocks_of(c, use_marks=True)
                if _size(b) >= MAIN_SHARE * whole and any(isinstance(x, Node) and x.tag in BLOCK for x in c.children):
                    down = c, b
                    break
        if down is None:
            break
        node, blocks = down
    return "\n".join(blocks)


def extract(page: str | None, template: Slot | None) -> str:
    if not page:
        return ""
    root = parse(page, is_apart)
    if template is not None:
        mark(condense(root), template)
    has_template = template is not None and _tells(template)
    found = main_text(root, has_template)
    if not found and open_forms(root):  # the page stands in a form as a whole
        found = main_text(root, has_template)
    return found


def _tells(template: Slot) -> bool:
    """Whether some text of a template is constant."""
    return bool(template.texts) or any(map(_tells, template.children))


def is_apart(node: Node) -> bool:
    return is_boilerplate(node, True)


def open_forms(node: Node) -> bool:
    """Let forms count as plain containers; their controls don't."""
    some = False
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == "form" and not c.plain:
                c.plain = some = True
            some = open_forms(c) or some
    return some


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Slot] = {}
    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1)):
            text = page.as_py()
            if not text:
                continue
            tree, host = condense(parse(text, is_apart)), host_of(url)
            held[host] = _bare(grown(held[host], tree) if host in held else tree)
            if len(held) >= HOSTS_HELD:
                yield _handed(held)
                held = {}
    yield _handed(held)


def _bare(s: Slot) -> Slot:
    s.nodes = []
    for c in s.children:
        _bare(c)
    return s


def _handed(held: dict[str, Slot]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(s.dump(), separators=(",", ":")) for s in held.values()], pa.string())], names=["host", "template"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the partial templates of each host; rows come sorted by host."""
    host, total = None, None
    for b in batches:
        done: dict[str, Slot] = {}
        for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = Slot.load(json.loads(t))
            if h == host:
                total = grown(total, own)
                continue
            if host is not None:
                done[host] = total
            host, total = h, own
        if done:
            yield _handed(done)
    if host is not None:
        yield _handed({host: total})


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, template for each host: partial templates of tasks meet in two rounds, so that a host with very many pages is spread."""
    parts = partitions(pages.sparkSession)
    schema = "host string, template string"
    first = pages.select(F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")).mapInArrow(trimmed(_induce), schema)
    salted = first.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(max(1, int(parts**0.5)))))
    # Sorted by the templates too, so that what merges with what does not hang on which task was first.
    once = salted.repartition(parts, "host", "salt").select("host", "template").sortWithinPartitions("host", "template").mapInArrow(trimmed(_combine), schema)
    return once.repartition(parts, "host").sortWithinPartitions("host", "template").mapInArrow(trimmed(_combine), schema)


def _with_template(table, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, str | None, Slot | None]]]]:
    """Batches of page_id, url, html (and template, without a table), and the host, page and template of each row."""
    loaded: dict[str, Slot | None] = {}
    for b in batches:
        rows = []
        for k, (url, page) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
            host = host_of(url)
            if host not in loaded:
                blob = table.value.get(host) if table is not None else b.column(3)[k].as_py()
                if table is None and len(loaded) >= HOSTS_HELD:
                    loaded.clear()
                loaded[host] = Slot.load(json.loads(blob)) if blob else None
            rows.append((host, page.as_py(), loaded[host]))
        yield b, rows


def _tally(table):
    """host, node, text, n: the pages that have a text at a node of their host's template; those that have any, under a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        places: dict[int, tuple[Slot, dict[int, int]]] = {}

        def handed() -> pa.RecordBatch:
            cols = list(zip(*((*key, n) for key, n in held.items()))) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "node", "text", "n"])

        for _, rows in _with_template(table, batches):
            for host, page, template in rows:
                if not page or template is None:
                    continue
                if id(template) not in places:
                    places = {} if len(places) >= HOSTS_HELD else places
                    places[id(template)] = template, {id(node): k for k, node in enumerate(numbered(template))}
                place = places[id(template)][1]
                for node, texts in texts_of(condense(parse(page, is_apart)), template):
                    at = place[id(node)]
                    held.update((host, at, t) for t in (None, *texts))
            if len(held) >= COUNTS_HELD:
                yield handed()
                held.clear()
        yield handed()

    return run


def is_constant(n: int, pages: int) -> bool:
    return n >= LEAST_PAGES and n >= CONSTANT_SHARE * pages


def _constants(counted: DataFrame) -> DataFrame:
    """host, constants: the constant texts of each host's template nodes."""
    counted = counted.groupBy("host", "node", "text").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    # Of a node no more texts can be constant than a page has there, so few rows are left to meet the pages of their node.
    counted = staged(counted, "counts")
    pages = counted.filter("text is null").select("host", "node", F.col("n").alias("pages"))
    fixed = counted.filter("text is not null").join(pages, ["host", "node"]).filter(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    return fixed.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("constants"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates with their constant texts."""
    for b in batches:
        done: dict[str, Slot] = {}
        for host, blob, constants in zip(*(c.to_pylist() for c in b.columns)):
            template = done[host] = Slot.load(json.loads(blob))
            nodes = numbered(template)
            for r in constants or []:
                nodes[r["node"]].texts.add(r["text"])
        yield _handed(done)


def learned(pages: list[str]) -> Slot:
    """The template of a few pages, without Spark."""
    trees = [condense(parse(p, is_apart)) for p in pages]
    template = trees[0]
    for t in trees[1:]:
        template = grown(template, t)
    seen: dict[int, Counter] = {id(node): Counter() for node in numbered(_bare(template))}
    for p in pages:
        for node, texts in texts_of(condense(parse(p, is_apart)), template):
            seen[id(node)].update((None, *texts))
    for node in numbered(template):
        own = seen[id(node)]
        node.texts = {t for t, n in own.items() if t is not None and is_constant(n, own[None])}
    return template


def _extract(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _with_template(table, batches):
            texts = [extract(page, template) for _, page, template in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _met(rows: DataFrame, templates: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows with the templates of their hosts: broadcast if they are small together, else joined."""
    size = templates.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = rows.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in templates.collect()})
        return rows.mapInArrow(trimmed(run(table)), schema)
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = spread_join(rows.withColumn("host", F.coalesce(host, F.lit(""))), templates, "host", "url", "left", most=0)
    return joined.select("page_id", "url", "html", "template").mapInArrow(trimmed(run(None)), schema)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars (code points of text).

    Character references are decoded, white space inside a block (ended by block tags and line breaks) is
    one space, blocks are joined by a line feed. A null or empty page gives an empty text; a null or
    malformed address belongs to the host ""; repeated rows give repeated rows; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    templates = staged(induce(pages, url_col, html_col), "templates")
    constants = _constants(_met(rows, templates, _tally, "host string, node int, text long, n long"))
    settled = staged(templates.join(constants, "host", "left").mapInArrow(trimmed(_settle), "host string, template string"), "settled")
    return _met(rows, settled, _extract, TEXT)
