"""The history of each conversation as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TURN = "conv_id LONG, turn INT, role STRING, text STRING, error STRING"
KEPT = "conv_id LONG, position INT, turn INT, role STRING, content STRING"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """Keeps of a conversation how many messages it has and which turn came last.

    A turn with an error leaves nothing, neither question nor answer; an empty answer is left out, while its question stays. A turn that comes
    again, or after a later one, has been told already and is left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "messages INT, turn INT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.told.get() if self.told.exists() else (0, -(1 << 31))
        out = []
        turns = pd.concat(list(rows)).sort_values(["turn"], kind="stable")
        for turn, role, text, error in zip(turns["turn"], turns["role"], turns["text"], turns["error"]):
            if turn <= last:
                continue
            last = int(turn)
            if pd.isna(error) and not (role == "assistant" and (pd.isna(text) or text == "")):
                out.append((key[0], n, last, role, None if pd.isna(text) else text))
                n += 1
        self.told.update((n, last))
        yield pd.DataFrame(out, columns=["conv_id", "position", "turn", "role", "content"])

    def close(self) -> None:
        pass


def history_stream(turns: DataFrame) -> DataFrame:
    """The messages that each turn of a stream (conv_id, turn, role, text, error) adds to its conversation, with their places.

    Turns of one conversation come in order from batch to batch and in any order within one. The state is one
    pair of numbers a conversation, whatever its length; the messages themselves go to the sink. The session needs ``PROVIDER`` as its state store.
    """
    keyed = turns.filter("conv_id is not null").groupBy("conv_id")
    return keyed.transformWithStateInPandas(History(), outputStructType=KEPT, outputMode="Append", timeMode="None")


def run_to_end(messages: DataFrame, store: str, checkpoint: str) -> None:
    """Take all that is there and end; the next run goes on from the checkpoint."""
    query = messages.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def histories(messages: DataFrame) -> DataFrame:
    """conv_id and its messages in order as array<struct<role, content>>, from what the stream wrote."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "role", "content")))
    return messages.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"], x["content"])).alias("history"))
