"""A one-hash filter of fixed size: which keys may be in a table. It only saves shuffling; joins decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import trimmed

#: At most 2 ** 24 bits (2 MB), whatever the input; a full filter passes more rows, never fewer.
MOST_BITS = 24


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys.astype("<i8").view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_place(b.column(0).to_numpy(), bits))
            if len(at):
                words, first = np.unique(at >> 5, return_index=True)
                value = np.bitwise_or.reduceat(np.int64(1) << (at & 31), first)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(value)], names=["word", "bits"])

    return run


class Passing:
    """Built from a DataFrame of one long column without nulls."""

    def __init__(self, keys: DataFrame) -> None:
        spark = keys.sparkSession
        self.bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(16 * keys.count() + 1)))))
        words = keys.mapInArrow(trimmed(_words(self.bits)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(1 << (self.bits - 5), dtype=np.uint32)
        table[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
        self.held = spark.sparkContext.broadcast(table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _place(keys, self.bits)
        return (self.held.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "held": self.held}

    def probe(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose first column (long, no nulls) may be among the keys."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(self(b.column(0).to_numpy())))

        return df.mapInArrow(trimmed(run), df.schema)
