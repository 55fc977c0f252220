"""Which of many words occur in a text: few are looked for one by one, many by one pass of an automaton over all of them.

A search for one word ends where it is found, while the automaton stops at every place of every word. The automaton is built once for each Python worker from the list that the function carries.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words that are looked for one by one at most.
FEW = 64


@lru_cache(32)
def _lowered(needles: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(x.lower() for x in needles)


@lru_cache(32)
def _automaton(needles: tuple[str, ...]):
    """The trie of lower-cased ``needles``, each with the places it has in the list; and the places of empty ones, which occur everywhere."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, x in enumerate(needles):
        places.setdefault(x.lower(), []).append(k)
    always, trie = places.pop("", []), ahocorasick.Automaton()
    for x, own in places.items():
        trie.add_word(x, tuple(own))
    trie.make_automaton()
    return trie, always


def _places(text: str, needles: tuple[str, ...]) -> set[int]:
    if len(needles) <= FEW:
        return {k for k, x in enumerate(_lowered(needles)) if x in text}
    trie, always = _automaton(needles)
    hits = {own for _, own in trie.iter(text)} if len(trie) else ()
    return {k for own in hits for k in own}.union(always)


def found(text: Column, needles: tuple[str, ...]) -> Column:
    """Places in the list of the needles that occur, without regard to case, rising; null for a null text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sorted(_places(x.lower(), needles)) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def groups_found(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Sorted names of the groups of which a needle occurs; null for a null text."""
    needles = tuple(x for own in groups.values() for x in own)
    names = tuple(name for name, own in groups.items() for _ in own)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sorted({names[k] for k in _places(x.lower(), needles)}) for x in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)
