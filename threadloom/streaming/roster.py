"""Streaming twins of the batch operators: deduplicated ingest, look-back counts, roster state, done sets by checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark's delay: a resumed scan without a table of what was seen."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per key and window; late rows within the delay still count."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"))


def interval_pairs(questions: DataFrame, edits: DataFrame, user: str, days: int, delay: str = "1 hour") -> DataFrame:
    """Events of a user in the days before its question, as a stream-stream join that watermarks bound."""
    q = questions.withWatermark("asked", delay).alias("q")
    e = edits.withWatermark("ts", delay).alias("e")
    return q.join(e, F.expr(f"q.{user} = e.{user} AND e.ts < q.asked AND e.ts >= q.asked - INTERVAL {days} DAYS"))


def roster_states(stream: DataFrame) -> DataFrame:
    """joined and left events of members from a stream of (member, seq, present): state is the last sequence and presence of a member."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, present = state.get if state.exists else (-1, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s, now in zip(rows["seq"], rows["present"]):
            if s <= seq:
                continue
            if bool(now) != present:
                out.append((key[0], int(s), "joined" if now else "left"))
            seq, present = int(s), bool(now)
        state.update((seq, present))
        yield pd.DataFrame(out, columns=["member", "seq", "event"])

    kind = stream.schema["member"].dataType.simpleString()
    return stream.groupBy("member").applyInPandasWithState(step, f"member {kind}, seq long, event string", "seq long, present boolean", "append", "NoTimeout")


def append_with_checkpoint(stream: DataFrame, path: str, checkpoint: str):
    """Appends each row once to parquet; the checkpoint is the done set."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
