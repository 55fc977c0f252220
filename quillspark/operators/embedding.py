"""Embedding as a pluggable Arrow function, with one model a worker, and a stand-in for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

Embedder = Callable[[list[str]], np.ndarray]
#: Texts gathered before they are dealt to calls by length, and characters of them at most.
WINDOW, WINDOW_CHARS = 2048, 8_000_000

_loaded: dict[str, object] = {}


def loaded(name: str, loader: Callable[[], object]):
    """What ``loader`` gives, loaded when a worker first needs it and then kept for all of its tasks, under ``name``."""
    if name not in _loaded:
        _loaded[name] = loader()
    return _loaded[name]


def hashed_words(texts: list[str], dimension: int = 64) -> np.ndarray:
    """A stand-in, not a model: signed counts of hashed words."""
    out = np.zeros((len(texts), dimension), dtype=np.float32)
    for k, t in enumerate(texts):
        for w in t.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            out[k, h % dimension] += 1 if h >> 31 else -1
    return out


def by_length(texts: list[str], embedder: Embedder, batch: int) -> np.ndarray:
    """The vectors in the order of the texts; a call gets ``batch`` texts of like length, as it pads to the longest."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    made = [np.asarray(embedder([texts[k] for k in order[s : s + batch]]), dtype=np.float32) for s in range(0, len(order), batch)]
    out = np.empty((len(texts), made[0].shape[1]), dtype=np.float32)
    out[order] = np.concatenate(made)
    return out


def windows(columns: Iterator[list[str]]) -> Iterator[list[str]]:
    """Texts of several Arrow batches together, so that a call need not be short because its batch was."""
    held: list[str] = []
    size = 0
    for texts in columns:
        for t in texts:
            held.append(t)
            size += len(t)
            if len(held) >= WINDOW or size >= WINDOW_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _vectors(texts: list[str], embedder: Embedder, normalize: bool, batch: int) -> np.ndarray:
    v = by_length(texts, embedder, batch)
    v[[not t for t in texts]] = 0
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if normalize else v


def embed(
    df: DataFrame, text: Column, embedder: Embedder | None = None, normalize: bool = True, name: str = "embedding", batch: int = 32,
    loader: Callable[[], Embedder] | None = None, model: str = "model", profile=None,
) -> DataFrame:
    """Adds the vector of each text, ``batch`` texts a call; an empty or null text has the zero vector.

    ``loader`` makes the model; each worker calls it once for a ``model`` name, when it first has a text. Without it ``embedder`` is called
    as it is (by default the stand-in). ``profile`` is a resource profile for the stage, such as one with an accelerator; the rows then
    pass through the workers as a whole.
    """

    def ready() -> Embedder:
        return loaded(model, loader) if loader else embedder or hashed_words

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in windows(s.fillna("").tolist() for s in columns):
            yield pd.Series(list(_vectors(texts, ready(), normalize, batch).astype(np.float32)))

    if profile is None:
        return df.withColumn(name, F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)(text))
    out = df.limit(0).withColumn(name, F.array().cast("array<float>")).schema
    kinds = to_arrow_schema(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            if texts:
                v = _vectors(texts, ready(), normalize, batch)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(v.astype(np.float32)), kinds.field(name).type)], schema=kinds)

    return df.select("*", text.alias("_text")).mapInArrow(rows, out, profile=profile)
