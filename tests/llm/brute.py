"""Plain versions of the operators, written from their contracts."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = "[\x20\x09-\x0d]+"


def dedup(rows):
    """(doc_id, text) to sorted (doc_id, keep_id, size, sha), ids not null."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(BLANK, "", t or "")].append((-len(t or ""), d))
    return sorted((d, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g)


def shingles(text, width):
    w = [x for x in re.split(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(rows, width, percent):
    """doc_id to (n, component), ids unique."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            lists[g].append(d)
    for d, s in sets.items():
        for e, i in Counter(e for g in s for e in lists[g] if e < d).items():
            if 100 * i >= percent * (len(s) + len(sets[e]) - i):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        n = int(c)
        if i % 2:
            n *= 2
        s += n if n < 10 else n - 9
    return s % 10 == 0


def spans(text):
    out = []
    for kind, rx in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out
