"""Conversation state kept up to date as turns arrive, in any order and perhaps more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vellum.streaming.ingest import started

TURN = "turn long, role string, text string"
STATE = f"conv_id long, {TURN}, n_messages long, n_chars long"


class Accumulate(StatefulProcessor):
    """State of a conversation: its messages, each once. New ones give their own sizes and those of all later messages anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", TURN, "n_chars long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names of the interface)
        # The state is read once, in order to know what is new: asking for each message would be a call each.
        said, first = {tuple(k): v[0] for k, v in self.said.iterator()}, None
        place = lambda m: tuple((v is not None, v) for v in m)  # noqa: E731  nulls first
        for frame in rows:
            for m in frame[["turn", "role", "text"]].astype(object).itertuples(index=False, name=None):
                m = tuple(None if pd.isna(v) else v for v in m)
                m = (None if m[0] is None else int(m[0]), *m[1:])
                if m not in said:
                    said[m] = len(m[2] or "")
                    self.said.updateValue(m, (said[m],))
                    first = m if first is None else min(first, m, key=place)
        if first is None:
            return
        out, n, chars = [], 0, 0
        for m, size in sorted(said.items(), key=lambda x: place(x[0])):
            n, chars = n + 1, chars + size
            if place(m) >= place(first):
                out.append((key[0], *m, n, chars))
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "n_messages", "n_chars"], dtype=object)
        yield frame.astype({"n_messages": "int64", "n_chars": "int64"})

    def close(self) -> None:
        pass


def conversation_stream(spark: SparkSession, turns: DataFrame, states_path: str, checkpoint: str) -> StreamingQuery:
    """Handle the turns (conv_id, turn, role, text) that a streaming table has, and stop: sizes of changed messages go to states_path, a folder for each batch.

    A message that comes again (equal in all four columns) changes nothing; one that comes late changes the
    sizes of the later ones. latest_states() has what operators.grounding.conversation_state gives for all distinct turns so far.
    """
    changed = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(Accumulate(), outputStructType=STATE, outputMode="Update", timeMode="None")

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{states_path}/batch={number}")

    return started(spark, lambda: changed.writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_states(spark: SparkSession, states_path: str) -> DataFrame:
    """(conv_id, turn, role, text, n_messages, n_chars) as of the last batch that changed each message."""
    rows = spark.read.schema(f"{STATE}, batch long").parquet(states_path)
    last = rows.groupBy("conv_id", "turn", "role", "text").agg(F.max(F.struct("batch", "n_messages", "n_chars")).alias("m"))
    return last.select("conv_id", "turn", "role", "text", "m.n_messages", "m.n_chars")
