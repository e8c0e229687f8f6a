"""Rollups of metric logs as a stream: JSON lines in, a table of windows out that is right whatever batch is written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.rollups import EVENTS

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ROLLUP = "window_start timestamp, event_type string, n long, total decimal(38,6), max_value double"


def append_log(events: DataFrame, folder: str) -> None:
    """Add events to a log of JSON lines."""
    names = [f.split()[0] for f in EVENTS.split(", ")]
    events.select(*names).write.mode("append").option("timestampFormat", STAMP).json(folder)


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 2) -> DataFrame:
    """The log as a stream; lines that do not parse have null fields."""
    return spark.readStream.schema(EVENTS).option("timestampFormat", STAMP).option("maxFilesPerTrigger", files_per_batch).json(folder)


def rollup(events: DataFrame, late: str, width: str = "1 day") -> DataFrame:
    """Count, exact sum and largest value by window and event type. A row is dropped once its window ended more than `late` before the newest row of former batches; rows without time are dropped."""
    frame = F.window("ts", width).alias("w")
    grouped = events.where("ts IS NOT NULL").withWatermark("ts", late).groupBy(frame, "event_type")
    made = grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(24,6)")).cast("decimal(38,6)").alias("total"), F.max("value").alias("max_value"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "max_value")


def run_rollup(spark: SparkSession, log: str, table: str, checkpoint: str, late: str, width: str = "1 day", files_per_batch: int = 2) -> None:
    """Take in what is new in the log and end; the next call goes on from the checkpoint.

    Every batch writes the windows that it has changed to a folder of its own number, over what a failed attempt may have left there.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = rollup(read_log(spark, log, files_per_batch), late, width)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def read_rollup(spark: SparkSession, table: str) -> DataFrame:
    """(window_start, event_type, n, avg_value, max_value): of every window what the last batch that changed it says."""
    rows = spark.read.schema(ROLLUP + ", batch long").option("basePath", table).parquet(table)
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total", "max_value"), "batch").alias("r"))
    return last.select("window_start", "event_type", "r.n", (F.col("r.total") / F.col("r.n")).cast("double").alias("avg_value"), "r.max_value")
