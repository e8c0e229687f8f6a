"""Structured Streaming over metric logs: windowed latency with late data, sessions, and the cache as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.state import Cache

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "*.parquet", files_per_batch: int = 8) -> DataFrame:
    """A stream of the files of a folder whose names fit."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files).parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Count, mean and largest value of each event type and window; rows later than `late` are dropped by the watermark."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "avg_value", "max_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "value")


def cache_stream(turns: DataFrame, capacity: int = 5) -> DataFrame:
    """Hits and moves of the cache for turns(session string, iteration long, wanted array<string>), state kept per session between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = Cache(capacity)
        if state.exists:
            hot, cache.hits, cache.misses = state.get
            cache.hot = list(hot)
        out = []
        rows = pd.concat(list(batches)).sort_values("iteration")
        for i, wanted in zip(rows["iteration"], rows["wanted"], strict=True):
            made = cache.turn([] if wanted is None else list(wanted))
            out.append((key[0], i, made["hits"], made["misses"], made["action"], made["hot"]))
        state.update((cache.hot, cache.hits, cache.misses))
        yield pd.DataFrame(out, columns=["session", "iteration", "hits", "misses", "action", "hot"])

    return turns.groupBy("session").applyInPandasWithState(step, "session string, iteration long, hits long, misses long, action string, hot long", "hot array<string>, hits long, misses long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, as a table in memory; for tests and reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
