"""Properties that cut and packed texts have, whatever way they were made, and a tidy form to compare with."""

import re


def tidy(t):
    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub("[\u00a0 \t]+", " ", t)
    return re.sub(r"\n\n\n+", "\n\n", t).strip()


def solid(t):
    return "".join(t.split())


#: What may stand at the end of a part that was cut at a break, as seen with the white space that follows.
BREAK_BEFORE = re.compile(r"(?:[;:]\s+|(?<!\d)\.\s+|\n+)\Z")


def check_parts(text, parts, most):
    """Parts hold all of the text, none is too long or blank, and each cut lies at the furthest break, else blank, that its window has."""
    assert solid("".join(parts)) == solid(text)
    if len(text) <= most:
        assert parts == [text]
        return
    assert all(p == p.strip() and 0 < len(p) <= most for p in parts)
    at = 0
    for k, part in enumerate(parts):
        lead = len(text[at:]) - len(text[at:].lstrip())
        assert text[at + lead :].startswith(part)
        end = at + lead + len(part)  # white space up to the next part belongs to the cut
        rest = len(text) if k + 1 == len(parts) else end + len(text[end:]) - len(text[end:].lstrip())
        high = min(at + most, len(text))
        window = range(at + most // 2, high + 1)
        breaks = [c for c in window if BREAK_BEFORE.search(text[:c]) and not (c < len(text) and BREAK_BEFORE.search(text[: c + 1]) and text[c].isspace())]
        if breaks:
            assert end <= breaks[-1] <= rest, (text, parts, k)
            at = breaks[-1]
            continue
        blanks = [c for c in window if at < c < high and text[c] == " "]
        cut = blanks[-1] if blanks and high < len(text) else high
        assert end <= cut <= max(rest, cut if cut == len(text) else rest), (text, parts, k)
        at = cut


def check_packs(units, parts, most):
    """Whole units joined by line feeds, in order; no two neighbours would have fitted; long units stand alone, cut."""
    left, fitting = [u for u in map(tidy, units) if u], []
    parts = list(parts)
    while left:
        if len(left[0]) > most:
            own, seen = [], ""
            while seen != solid(left[0]):
                own.append(parts.pop(0))
                seen += solid(own[-1])
            check_parts(left.pop(0), own, most)
            fitting = []
            continue
        taken, size = [], -1
        while left and len(left[0]) <= most and size + 1 + len(left[0]) <= most:
            size += 1 + len(left[0])
            taken.append(left.pop(0))
        assert parts.pop(0) == "\n".join(taken)
    assert not parts and not fitting
