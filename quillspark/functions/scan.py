"""Sequential scans of whole texts, as Arrow functions: each reads a text once, from left to right.

Built-in expressions give no offsets of matches, and a fold copies what it has found at every step, so both cost the square of a
long text. Rows that need no scan pass a null and stay in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = "struct<start:int,number:string,forward:boolean,shown:string,chapter:string>"
_TEXTS = pa.list_(pa.string())
#: Where a long text may be cut: after a sentence or clause, or at a line end (fixed value).
BREAK = r"[;:]\s+|(?<!\d)\.\s+|\n+"


def _each(kind: pa.DataType, returns: str, make: Callable) -> Callable:
    """``make`` of each value as an Arrow function; a null gives a null."""

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else make(x) for x in a.to_pylist()], kind)

    return F.arrow_udf(run, returns)


@lru_cache(64)
def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)


@lru_cache(64)
def _at_lines(pattern: str, flags: int) -> bool:
    """Whether a match can only begin at a line start: ``^`` stands before all of the pattern."""
    bare, depth = re.sub(r"\A\(\?[a-zA-Z]+\)", "", pattern), 0
    if not bare.startswith("^") or not _compiled(pattern, flags).flags & re.MULTILINE or _compiled(pattern, flags).flags & re.VERBOSE:
        return False
    for x in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|.", bare, re.DOTALL):
        depth += {"(": 1, ")": -1}.get(x, 0)
        if x == "|" and not depth or x in ("?", "*", "{") and bare[:2] == "^" + x:
            return False
    return True


def _starts(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def _found(whole: str, starts: list[int], pattern: str, flags: int) -> Iterator[re.Match]:
    """What ``finditer`` finds; a pattern that begins at line starts is tried at these alone."""
    compiled = _compiled(pattern, flags)
    if not _at_lines(pattern, flags):
        yield from compiled.finditer(whole)
        return
    end = 0
    for at in starts:
        if at >= end and (m := compiled.match(whole, at)):
            yield m
            end = m.end() + (m.end() == at)


def _tidy(text: str) -> str:
    """``text.normalize_whitespace`` of a text whose lines end in line feeds."""
    if "\t" in text or "\u00a0" in text or "  " in text:
        text = _compiled("[\u00a0\t][\u00a0 \t]*| [\u00a0 \t]+", 0).sub(" ", text)
    if "\n\n\n" in text:
        text = _compiled("\n{3,}", 0).sub("\n\n", text)
    return text.strip()


def clean_lines(text: Column, first: tuple[str, ...], noise: tuple[str, ...]) -> Column:
    """The tidy text of stripped lines; before the first line that a pattern of ``first`` (without regard to case) finds, empty and noise lines are left out."""

    def clean(whole: str) -> str:
        own, rules = [x.strip() for x in whole.splitlines()], [_compiled(p, re.IGNORECASE) for p in first]
        at = next((i for i, x in enumerate(own) if any(r.search(x) for r in rules)), len(own))
        return _tidy("\n".join([x for x in own[:at] if x and not x.startswith(noise)] + own[at:]))

    return _each(pa.string(), "string", clean)(text)


def _sections(whole: str, usual: tuple, other: tuple, chapters: tuple) -> Iterator[tuple]:
    starts = _starts(whole)

    def by_start(patterns: tuple) -> list[re.Match]:
        held: dict[int, re.Match] = {}
        for p, flags in patterns:
            for m in _found(whole, starts, p, flags):
                held.setdefault(m.start(), m)
        return [held[at] for at in sorted(held)]

    found = by_start(usual) or by_start(other)
    over = sorted((m.start(), rank, m[0].strip()) for rank, (p, flags) in enumerate(chapters) for m in _found(whole, starts, p, flags)) if found else []
    met, chapter = 0, None
    for m, end in zip(found, [*(n.start() for n in found[1:]), len(whole)]):
        while met < len(over) and over[met][0] <= m.start():
            chapter, met = over[met][2], met + 1
        if block := whole[m.start() : end].strip():
            first = block.splitlines()[0].strip()
            forward = first.lower().startswith("člen ")
            yield m.start(), m[1], forward, block if forward and len(first.split()) > 2 else whole[m.end() : end].strip(), chapter


def sections(text: Column, usual: tuple, other: tuple, chapters: tuple) -> Column:
    """The articles of each text as array<struct<start, number, forward, shown, chapter>>, none for a null: offsets count code points from 0, number is the first group.

    Patterns come with their flags. Headings meet by their start, where the first pattern counts; ``other`` ones stand in where there are no ``usual``. An article goes to the next
    start, blank ones are left out; ``shown`` is what follows its heading, and with a forward heading of more than two words all of it; the last chapter that begins at or before it governs it.
    """

    def run(a: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for x in a.to_pylist():
            rows += _sections(x, usual, other, chapters) if x else ()
            ends.append(len(rows))
        kinds = {"start": pa.int32(), "number": pa.string(), "forward": pa.bool_(), "shown": pa.string(), "chapter": pa.string()}
        columns = zip(*rows) if rows else [()] * len(kinds)
        held = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)

    return F.arrow_udf(run, f"array<{SECTION}>")(text)


def _parts(text: str, most: int) -> Iterator[str]:
    """A text longer than ``most`` in parts: breaks are met once and in order, ``last`` being the furthest within reach."""
    breaks = (m.end() for m in _compiled(BREAK, 0).finditer(text))
    size, at, last, ahead = len(text), 0, -1, next(breaks, None)
    while at < size:
        low, high = at + most // 2, min(at + most, size)
        while ahead is not None and ahead <= high:
            last, ahead = ahead, next(breaks, None)
        if last >= low:
            cut = last
        else:
            blank = text.rfind(" ", low, high) if high < size else -1
            cut = blank if blank > at else high
        if part := text[at:cut].strip():
            yield part
        at = size if cut >= size else max(cut, at + 1)


def long_parts(text: Column, most: int) -> Column:
    """Parts of a text: cut after the last break in the upper half of each window, else at its last blank, else at its end.

    A rest shorter than a window is still cut at a break in its upper half. A text of ``most`` characters or fewer is one part.
    """
    long = F.length(text) > most
    cut = _each(_TEXTS, "array<string>", lambda whole: list(_parts(whole, most)))
    return F.when(~long, F.array(text)).otherwise(cut(F.when(long, text)))


def packed(units: Column, most: int) -> Column:
    """Neighbouring units (tidy, none empty) joined by line feeds while they fit; a unit that is too long stands alone, in parts."""

    def pack(held: str) -> list[str]:
        own, out = json.loads(held), []
        room = -1  # in the last part; a unit needs one place more, for the line feed
        for unit in own:
            if len(unit) > most:
                out += _parts(unit, most)
                room = -1
            elif len(unit) < room:
                out[-1] = [*out[-1], unit]
                room -= len(unit) + 1
            else:
                out.append([unit])
                room = most - len(unit)
        return [x if isinstance(x, str) else "\n".join(x) for x in out]

    whole = F.array_join(units, "\n")
    fits = (F.size(units) > 0) & (F.length(whole) <= most)
    # Sent as text: with a list among the arguments Spark measures the whole batch anew for each row.
    several = _each(_TEXTS, "array<string>", pack)(F.to_json(F.when(~fits & (F.size(units) > 0), units)))
    return F.when(units.isNotNull(), F.when(fits, F.array(whole)).otherwise(F.coalesce(several, F.array().cast("array<string>"))))
