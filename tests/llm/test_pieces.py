import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quillspark.llm import pieces as op
from quillspark.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(packed):
    return memoryview(bytes(packed)).cast("I").tolist()


def test_random_texts_equal_the_library(library):
    rng = random.Random(5)
    model = op.PieceModel(PATH)
    odd = list("aabcdefghij   ▁\n\t.,'-0123456789éàüß漢字日本語한글😀\x00 ﬁ́") + ["the ", "ing", "    ", "  \n", "<s>", "</s>", "<0x0A>", "<unk>", "http://", ";\n", "//", "aaa", "mm"]
    own = list(model.score)
    for k in range(4000):
        text = "".join(rng.choices(odd, k=rng.randint(0, 40))) if k % 2 else "".join(rng.choices(own, k=rng.randint(1, 9))).replace("▁", " ")
        assert ids(model.encode(text)) == library.encode(text, add_bos=True, add_eos=True), repr(text)


def test_each_prefix_has_one_last_token(library):
    """The table's entry for each prefix is the last token of that prefix alone."""
    model = op.PieceModel(PATH)
    for word in ("▁unbelievable", "▁▁▁▁return", "▁aaaaaaa", "▁naïveté", "▁漢字テスト"):
        last = model.last_tokens(word)
        for k in range(1, len(word) + 1):
            size, token = last[k]
            if k > 1:
                assert (model.ids(word[:k])[-4:], token == op.FOREIGN) == (library.encode(word[1:k])[-1].to_bytes(4, "little"), word[k - 1] not in "".join(model.score))
            assert token == op.FOREIGN or model.pieces[token] == word[k - size : k]


def test_few_kept_words_change_nothing(monkeypatch, library):
    monkeypatch.setattr(op, "KEPT_WORDS", 3)
    monkeypatch.setattr(op, "KEPT_PAIRS", 5)
    model = op.PieceModel(PATH)
    text = "one two three one four five two one six " * 3
    assert ids(model.encode(text)) == library.encode(text, add_bos=True, add_eos=True)


def test_models_of_other_kinds_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "is_unused", lambda self, i: i == 500)
    with pytest.raises(ValueError):
        op.PieceModel(PATH)


def test_odd_rows(spark, odd, nothing, library):
    made = op.decode(op.encode(odd))
    assert made.columns == [*odd.columns, "ids", "decoded"]
    rows = made.collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert ids(r["ids"]) == want and r["decoded"] == library.decode(want)
    assert op.decode(op.encode(nothing)).count() == 0
    with pytest.raises(ValueError):
        op.encode(odd, ids_col="Text")


def test_query_equals_the_library(spark, sf, library):
    rows = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in want)
        r = rows.pop(d["doc_id"])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())
    assert not rows
