"""A small tolerant HTML reader: nested nodes of tag, attributes and children."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends open elements of these tags, up to the nearest of the second set.
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements that an open paragraph cannot hold, and elements inside which an outer paragraph stays open.
ENDS_P = BLOCK - {"option", "optgroup", "body", "html"}
P = frozenset({"p"})
KEEPS_P = frozenset({"td", "th", "table", "button", "object", "caption"})

#: Levels of the tree; what is nested deeper lies flat in the deepest element, so that no page can exhaust the stack.
MOST_DEPTH = 200

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_END_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


@lru_cache(maxsize=8192)
def attributes(raw: str) -> dict[str, str]:
    """Of an opening tag; not to be changed, as equal tags share them."""
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


class Node:
    __slots__ = ("tag", "raw", "children", "_attrs", "mark", "plain")

    def __init__(self, tag: str, raw: str = "") -> None:
        self.tag, self.raw, self.children, self._attrs, self.mark, self.plain = tag, raw, [], None, None, False

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = attributes(self.raw)
        return self._attrs


def parse(page: str, apart: Callable[[Node], bool] = lambda node: False) -> Node:
    """The tree of ``page``; unclosed elements end where their parents do, stray end tags are ignored.

    Below the last level only elements that are ``apart`` from their surroundings are nodes of their own, and blocks
    leave a line break at either end.
    """
    root = Node("#root")
    stack, levels, at, size = [root], [0], 0, len(page)
    opened: Counter = Counter()

    def close(k: int) -> None:
        for node in reversed(stack[k:]):
            opened[node.tag] -= 1
            if levels.pop() < 0 and node.tag in BLOCK:
                node.children.append(Node("br"))
        del stack[k:]

    def close_nearest(ends: frozenset, stops: frozenset) -> None:
        """Close the nearest open element of ``ends``, if none of ``stops`` is nearer."""
        if any(opened[t] for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    return close(k)
                if stack[k].tag in stops:
                    return None

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        m = None
        if nxt in "!?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                end = size if end < 0 else end + 1
        elif nxt.isalpha() or nxt == "/":
            m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
            end = m.end() if m else lt + 1
        else:
            end = lt + 1
        if m is None and nxt not in ("!", "?"):  # a bare "<" is text
            stack[-1].children.append(page[at:end])
            at = end
            continue
        if lt > at:
            stack[-1].children.append(page[at:lt])
        at = end
        if m is None:
            continue
        tag = m[1].lower()
        if nxt == "/":
            close_nearest(frozenset((tag,)), frozenset())
            continue
        if tag in ENDS_P:
            close_nearest(P, KEEPS_P)
        if tag in CLOSES:
            close_nearest(*CLOSES[tag])
        node = Node(tag, m[2])
        stack[-1].children.append(node)
        if tag in RAW:
            e = _END_RAW[tag].search(page, at)
            node.children.append(page[at : e.start() if e else size])
            at = e.end() if e else size
        elif tag not in VOID:  # even "<div/>" opens a div in HTML
            level = abs(levels[-1]) + 1
            if level > MOST_DEPTH + 1 or level == MOST_DEPTH + 1 and not apart(node):
                level = -abs(levels[-1])  # flat: the element writes into the one around it
                within = stack[-1].children
                within.pop()
                node.children = within
                if tag in BLOCK:
                    within.append(Node("br"))
            stack.append(node)
            levels.append(level)
            opened[tag] += 1
    return root
