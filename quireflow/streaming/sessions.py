"""Structured Streaming over events and chat turns. State is bounded by watermarks and timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """start, event_type, n, total over event time; rows later than the lateness are dropped."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: runs of events with gaps shorter than the time to live; a session ends when it would expire."""
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def expiring_sessions(events: DataFrame, ttl_seconds: int = 3600, lateness: str = "1 hour") -> DataFrame:
    """user_id, last_seen, n, expired: emits a session when event time passes its last event by the time to live."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")], "n": [n], "expired": [True]})
            return
        last, n = state.get if state.exists else (0, 0)
        for b in batches:
            last, n = max(last, int(b["ts"].max().timestamp() * 1000)), n + len(b)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = events.select("user_id", "ts").withWatermark("ts", lateness).groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, last_seen timestamp, n long, expired boolean", "last long, n long", "append", "EventTimeTimeout")


def latest_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text: the last user turn of each conversation so far; for update or complete output."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")
