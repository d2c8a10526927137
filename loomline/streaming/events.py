"""Event streams: windows, sessions, audit completion and conversation state.

Each function takes a streaming or a batch DataFrame; on a batch the watermark has no effect and
the result is the stream's final one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.functions import fold


def source(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over a folder's parquet files; a ts without a time zone is taken in the session's."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each event type in event-time windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions, ended by a gap."""
    s = F.session_window("ts", gap)
    g = events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def audit_completion(samples: DataFrame, expected: int, late: str = "10 minutes", patience_ms: int = 86_400_000) -> DataFrame:
    """(task_id, rewards, complete): a task's record, emitted when its last expected sample has come.

    Time is that of the samples' `ts`: a task that gets no sample for `patience_ms` after its last, by the
    watermark, is emitted as it is, with `complete` false. So the same events give the same rows again.
    """

    streaming = samples.isStreaming

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = json.loads(state.get[0]) if state.exists else ({}, 0)
        row = lambda whole: pd.DataFrame({"task_id": [key[0]], "rewards": [[held[k] for k in sorted(held, key=int)]], "complete": [whole]})
        if state.hasTimedOut:
            state.remove()
            yield row(False)
            return
        for b in batches:
            held.update((str(k), v) for k, v in zip(b["sample"], b["reward"], strict=True))
            last = max([last, *(int(t.value // 1_000_000) for t in b["ts"])])
        if len(held) >= expected:
            state.remove()
            yield row(True)
        else:
            state.update((json.dumps([held, last]),))
            if streaming:
                state.setTimeoutTimestamp(max(last + patience_ms, state.getCurrentWatermarkMs() + 1))

    out = samples.withWatermark("ts", late) if streaming else samples
    timeout = GroupStateTimeout.EventTimeTimeout if streaming else GroupStateTimeout.NoTimeout
    return out.groupBy("task_id").applyInPandasWithState(update, "task_id long, rewards array<double>, complete boolean", "held string", "append", timeout)


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turns, calls, end_reason) after each batch of messages, by the fold that replays batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else fold.opened()
        for b in batches:
            for role, text in b.sort_values("turn")[["role", "text"]].itertuples(index=False):
                s = fold.step(s, role or "", text or "")
        state.update((json.dumps(s),))
        yield pd.DataFrame([[key[0], s["turns"], s["calls"], s["end"] or "open"]], columns=["conv_id", "turns", "calls", "end_reason"])

    return messages.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turns long, calls long, end_reason string", "state string", "update", GroupStateTimeout.NoTimeout)


def checkpointed(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A file sink that appends each batch once."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
