"""Calls whose replies are written as they come, so that a broken run goes on where it stopped.

Requests are dealt into buckets by their key, and a bucket is one task with a folder of its own. Each reply is appended to
a file there before the next counts as done. A task that starts, for the first time, again after its executor was lost, or in a later run,
first reads the folder and leaves out the keys that it finds: no reply that was written is asked for again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.evaluate import tried

LINE = "key STRING, reply STRING, error STRING"
#: Lines of a file; a store that shows a file only when it is closed loses at most these with an executor.
LINES_A_FILE = 1000


def _folder(path: str, bucket: int):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    where = f"{root}/bucket={bucket}"
    store.create_dir(where, recursive=True)
    return store, where


def _done(store, where: str, again: bool) -> set[str]:
    """Keys in the folder; a line cut short by a killed task is no reply, nor is an error that is to be asked again."""
    from pyarrow import fs

    keys = set()
    for info in store.get_file_info(fs.FileSelector(where)):
        with store.open_input_stream(info.path) as f:
            for line in f.read().split(b"\n"):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if not (again and row["error"] is not None):
                    keys.add(row["key"])
    return keys


class _Journal:
    """Appends lines to a file of this attempt, and starts another when it is full."""

    def __init__(self, store, where: str) -> None:
        self.store, self.where, self.file, self.lines = store, where, None, 0

    def write(self, key: str, reply: str | None, error: str | None) -> None:
        if self.file is None or self.lines >= LINES_A_FILE:
            self.close()
            self.file, self.lines = self.store.open_output_stream(f"{self.where}/{uuid.uuid4().hex}.jsonl", compression=None), 0
        self.file.write(json.dumps({"key": key, "reply": reply, "error": error}, ensure_ascii=False).encode() + b"\n")
        self.file.flush()
        self.lines += 1

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _replies(path: str, client: Callable[[str], str], tries: int, wait_s: float, at_once: int, fail_fast: bool, again: bool):
    ask = tried(client, fail_fast, tries, wait_s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _folder(path, bucket := TaskContext.get().partitionId())
        done, journal, called, left = _done(store, where, again), _Journal(store, where), 0, 0
        try:
            with ThreadPoolExecutor(at_once) as pool:
                running = {}

                def settle(most: int) -> None:
                    while len(running) > most:
                        for f in wait(running, return_when=FIRST_COMPLETED).done:
                            journal.write(running.pop(f), *f.result())

                for b in batches:
                    for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        if key in done:
                            left += 1
                            continue
                        done.add(key)
                        settle(at_once - 1)
                        running[pool.submit(ask, text)] = key
                        called += 1
                settle(0)
        finally:
            journal.close()
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([called]), pa.array([left])], names=["bucket", "called", "left"])

    return run


def replies(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """``key``, reply and call_error of all that was written, one row a key: a reply rather than an error."""
    lines = spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(path).select("key", "reply", "error").filter("key is not null")
    best = F.min_by(F.struct("reply", "error"), F.struct(F.col("error").isNotNull(), "reply", "error")).alias("x")
    return lines.groupBy("key").agg(best).select(F.col("key").alias(key), F.col("x.reply").alias("reply"), F.col("x.error").alias("call_error"))


def ask_all(requests: DataFrame, key: str, column: str, client: Callable[[str], str], path: str, buckets: int = 64, tries: int = 1, wait_s: float = 1.0, at_once: int = 1, fail_fast: bool = False, again: bool = False) -> tuple[DataFrame, int]:
    """All replies to ``requests`` as a table (key, reply, call_error), and how many calls this run made.

    ``path`` is a folder that all executors write to; it and ``buckets`` must stay the same from run to run. A key
    that stands on several rows is asked once. With ``again`` keys that have only an error are asked again; with ``fail_fast``
    a failed call ends the run, and what was written till then stays. Requests without a key are left out.
    """
    dealt = requests.select(F.col(key).cast("string").alias("key"), F.col(column).cast("string").alias("text")).filter("key is not null")
    dealt = dealt.repartitionById(buckets, F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    run = dealt.mapInArrow(_replies(path, client, tries, wait_s, at_once, fail_fast, again), "bucket int, called long, left long")
    called = run.agg(F.sum("called")).first()[0]
    return replies(requests.sparkSession, path, key), called or 0
