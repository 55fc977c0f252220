"""Streamed chat replies as a source: lines ``data: {...}`` of completion chunks, each reply ended by ``data: [DONE]``.

Logged streams lie as files in a folder. ``spark.read`` takes all of them, ``spark.readStream`` those that are new; a file is one
task. Deltas are rows with their place, so that the text of a reply is a fold over them in any order of arrival.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: reply: the id that its chunks name; place: in the file; kind: delta, done or broken.
DELTA = "file STRING, place LONG, reply STRING, kind STRING, content STRING"


def parsed(lines: Iterable[bytes]) -> Iterator[tuple[int, str | None, str, str | None]]:
    """place, reply, kind, content of the events in ``lines``. Lines that carry no data are skipped; an end, or a chunk that is no JSON, is that
    of the reply before it."""
    reply = None
    for place, line in enumerate(lines):
        text = line.decode("utf-8", "replace").strip()
        if not text.startswith("data:"):
            continue
        data = text[len("data:") :].strip()
        if data == "[DONE]":
            yield place, reply, "done", None
            continue
        try:
            chunk = json.loads(data)
            content = chunk["choices"][0]["delta"].get("content") if chunk["choices"] else None
            reply = chunk.get("id", reply)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            yield place, reply, "broken", data
            continue
        if content:
            yield place, reply, "delta", content


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Files:
    def __init__(self, path: str) -> None:
        self.path = path

    def listed(self) -> list[str]:
        """Files by time and name, so that new ones come last."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [x.path for x in sorted(found, key=lambda x: (x.mtime_ns or 0, x.path)) if x.is_file and not x.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with _store(self.path)[0].open_input_file(partition.path) as f:
            name = partition.path.rsplit("/", 1)[-1]
            for event in parsed(io.BufferedReader(f)):
                yield (name, *event)


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.listed()] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return iter(()) if not partition.path else _Files.read(self, partition)


class _StreamReader(_Files, DataSourceStreamReader):
    """The offset is the number of files that were there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(self.listed())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(p) for p in self.listed()[start["files"] : end["files"]]]

    def commit(self, end: dict) -> None:
        pass


class TokenStream(DataSource):
    """``format("token_stream").load(folder)``; files are never changed once they are there."""

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return DELTA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TokenStream)
    return spark.read.format("token_stream").load(folder)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TokenStream)
    return spark.readStream.format("token_stream").load(folder)


def replies(deltas: DataFrame) -> DataFrame:
    """reply, answer, state: the deltas of each reply in their order; broken if a chunk was, unfinished if no end came, else finished.

    Events before the first chunk of a file belong to no reply and are left out; a reply's chunks are in one file.
    """
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("file", "place", "content"))))
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    state = F.when(has("broken"), "broken").when(has("done"), "finished").otherwise("unfinished")
    made = deltas.filter("reply is not null").groupBy("reply").agg(said.alias("d"), state.alias("state"))
    return made.select("reply", F.array_join(F.transform("d", lambda x: x["content"]), "").alias("answer"), "state")
