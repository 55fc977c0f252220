"""Encoding and decoding with a pair-merging piece model, by a table of the last token of each prefix.

In such a model any two neighbours whose joined text is a piece may merge, the highest score first, the
leftmost of equal ones. Two facts make a left-to-right pass exact. Tokens are the encoding of their joined
text if and only if each encodes itself and each neighbouring pair encodes as that pair: until a merge crosses
a border, what happens on its two sides happens as if the pair stood alone. And as a text has one
encoding, each prefix has one last token. So an automaton finds the pieces that end at each place, the one
that is compatible with the last token before it is stored, and the ids are read from the end backwards.

No piece holds a blank after anything else, nor a character that is foreign to all pieces, so no merge crosses
such a place: a text falls into words, and each worker keeps the ids of the words that it met last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, trimmed

BLANK = "▁"
#: Words that a worker keeps in each of two generations, and the longest one that is kept.
KEPT_WORDS, LONGEST_KEPT = 200_000, 64
#: Pairs whose compatibility a worker keeps.
KEPT_PAIRS = 2_000_000
#: Characters of text in one batch of results.
BATCH_CHARS = 4_000_000
#: Stands for a character that is in no piece: it merges with nothing.
FOREIGN = -1
END = float("-inf")

_models: dict = {}


class PieceModel:
    """The pieces of a model file with what encoding needs; one for each Python worker."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.library
        self.size = p.get_piece_size()
        usual = [i for i in range(self.size) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i))]
        if any(p.is_unused(i) for i in usual) or not p.is_byte(p.piece_to_id("<0x00>")):
            raise ValueError("models with unused pieces or without byte pieces are not supported")
        self.begin, self.end = p.bos_id(), p.eos_id()
        self.pieces = {i: p.id_to_piece(i) for i in usual}
        self.score = {p.id_to_piece(i): p.get_score(i) for i in usual}
        self.by_bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # Characters that occur in pieces only together with others are tokens here, with numbers of their own.
        alone = sorted({c for x in self.score for c in x} - set(self.score))
        self.pieces |= {self.size + k: c for k, c in enumerate(alone)}
        self.automaton = ahocorasick.Automaton()
        for i, x in self.pieces.items():
            if len(x) == 1 or len(self.spine(x)[0]) == len(x):
                self.automaton.add_word(x, (len(x), i))
        self.automaton.make_automaton()
        self.spines: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", x) for x in self.score)
        own = "".join(re.escape(c) for c in sorted({c for x in self.score for c in x} - {BLANK}))
        self.split = re.compile(f"{BLANK}+[{own}]*|[{own}]+|[^{own}{BLANK}]+" if apart else "(?s).+").findall

    def spine(self, piece: str) -> tuple[list, list]:
        """How a piece is made from its characters: the score of each merge with the outermost part on the
        left, and with that on the right, before it. The last entry has no further merge. A piece that does not become whole has fewer entries than characters."""
        parts, left, right = list(piece), [], []
        while True:
            found = [(s, -k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1])) is not None]
            s, k = max(found, default=(END, 0))
            left.append((s, parts[0]))
            right.append((s, parts[-1]))
            if s == END:
                return left, right
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the pair encodes as itself: no merge crosses the border while both sides are made."""
        for x in (a, b):
            if x not in self.spines:
                self.spines[x] = self.spine(self.pieces[x])
        before, after = self.spines[a][1], self.spines[b][0]
        i = j = 0
        while True:
            (s, x), (t, y) = before[i], after[j]
            across = self.score.get(x + y)
            if across is not None and across > s and across >= t:  # of equal scores the leftmost goes first
                return False
            if s == END and t == END:
                return True
            if s >= t:
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list:
        """For each prefix of ``text`` the length and id of its last token."""
        foreign = (1, FOREIGN)
        last = [foreign] * (len(text) + 1)
        pairs, find = self.pairs, self.pairs.get
        for end, token in self.automaton.iter(text):
            if last[end + 1] is not foreign:
                continue
            before = last[end + 1 - token[0]][1] if end >= token[0] else FOREIGN
            if before != FOREIGN:
                pair = (before, token[1])
                fits = find(pair)
                if fits is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(*pair)
                if not fits:
                    continue
            last[end + 1] = token
        return last

    def ids(self, text: str) -> bytes:
        """Ids of a normalised text as little-endian 32-bit integers; what is no piece goes by its bytes."""
        last, out, at = self.last_tokens(text), [], len(text)
        while at:
            size, token = last[at]
            at -= size
            if 0 <= token < self.size:
                out.append(token)
            else:
                out += [self.by_bytes[b] for b in reversed(text[at : at + size].encode())]
        return b"".join(i.to_bytes(4, "little") for i in reversed(out))

    def word(self, text: str) -> bytes:
        """Ids of a word; those met last are kept in two generations."""
        found = self.words.get(text) or self.older.get(text) or self.ids(text)
        if len(text) <= LONGEST_KEPT:
            if len(self.words) >= KEPT_WORDS:
                self.words, self.older = {}, self.words
            self.words[text] = found
        return found

    def encode(self, text: str) -> bytes:
        get, word = self.words.get, self.word
        out = [get(x) or word(x) for x in self.split(self.library.normalize(text))]
        return self.begin.to_bytes(4, "little") + b"".join(out) + self.end.to_bytes(4, "little")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _passed(schema: pa.Schema, make) -> object:
    """An Arrow function: the first column of a batch goes through ``make``, the others are kept; results go out in
    slices of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, made, size, first = b.columns[1:], [], 0, 0

            def slices(stop):
                return pa.RecordBatch.from_arrays([pa.array(made, schema.field(0).type), *(c.slice(first, stop - first) for c in rest)], schema=schema)  # noqa: B023

            for k, x in enumerate(b.column(0)):
                value = make(x.as_py())
                made.append(value)
                size += len(value)
                if size >= BATCH_CHARS:
                    yield slices(k + 1)
                    made, size, first = [], 0, k + 1
            if made:
                yield slices(b.num_rows)

    return run


def _applied(df: DataFrame, in_col: str, out_col: str, kind: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    if out_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out_col}")
    name = fresh(df, "__in")
    kinds = {"string": F.lit("").cast("string"), "binary": F.lit(b"").cast("binary")}
    one = df.sparkSession.range(0).select(kinds[kind].alias(out_col)).schema[0].dataType
    out = StructType([StructField(out_col, one), *df.schema.fields])
    table = df.select(F.col(f"`{in_col}`").alias(name), *(F.col(f"`{c}`") for c in df.columns))
    made = table.mapInArrow(trimmed(_passed(to_arrow_schema(out), make)), out)
    return made.select(*(F.col(f"`{c}`") for c in df.columns), F.col(f"`{out_col}`"))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text, begin and end included, as packed little-endian 32-bit integers.

    A null text counts as empty, which gives begin and end alone. Rows are encoded one by one, so repeated
    rows and an empty table are nothing special; all columns are kept, and ``ids_col`` must not be one of them.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return _applied(df, text_col, ids_col, "binary", lambda x: model(path).encode(x or ""))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``df`` with the text of packed ids, as the library decodes them; null ids give an empty text."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return _applied(df, ids_col, text_col, "string", lambda x: model(path).library.decode(memoryview(x or b"").cast("I").tolist()))
