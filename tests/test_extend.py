"""Extension chains, and streams of metric logs that are stopped and started."""

import datetime
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import extend as E
from tessera.streaming import metriclog as M


def test_chain_records_who_answered_and_bad_rows_cost_themselves(spark):
    def picky():
        def run(words):
            if any(w == "bad" for w in words.to_pylist()):
                raise ValueError("bad row")
            return pa.array([w + "!" if w and w.startswith("b") else None for w in words.to_pylist()])

        return run

    def broken():
        raise RuntimeError("cannot be loaded")

    words = ["big", "bad", "cat", None, "bed", "dogs"] * 50
    frame = spark.createDataFrame([(i, w, "old") for i, w in enumerate(words)], "id int, word string, MADE string").repartition(3)
    chain = [E.Extension("broken", broken, "string"), E.Extension("picky", picky, "string"), "plural", "lower"]
    found = E.answer(frame, "normaliser", chain, ["word"], "made")
    assert found.columns == ["id", "word", "made", "made_by"]
    got = {(r.word, r.made, r.made_by) for r in found.collect()}
    assert got == {("big", "big!", "picky"), ("bad", "bad", "lower"), ("cat", "cat", "lower"), (None, None, None), ("bed", "bed!", "picky"), ("dogs", "dog", "plural")}
    assert E.answer(frame.limit(0), "normaliser", chain, ["word"], "made").collect() == []
    nobody = E.answer(frame, "normaliser", [E.Extension("broken", broken, "string")], ["word"], "made").collect()
    assert all(r.made is None and r.made_by is None for r in nobody) and len(nobody) == len(words)
    with pytest.raises(KeyError):
        E.answer(frame, "normaliser", ["unknown"], ["word"], "made")


def test_loaded_once_a_worker(spark, tmp_path):
    def load(folder=str(tmp_path)):
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda words: words

    frame = spark.range(4000).select(F.col("id").cast("string").alias("word")).repartition(8)
    assert E.answer(frame, "normaliser", [E.Extension("counted", load, "string", rows=10)], ["word"], "made").where("made = word").count() == 4000
    made = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert len(made) == len(set(made)) >= 1


def test_what_is_there_from_the_start(spark):
    rows = spark.createDataFrame([("The stone, Anna said, is a big stone", "stone is big"), ("", "x"), (None, None)], "a string, b string")
    by = E.answer(E.answer(rows, "extractor", ["capitals", "frequent"], ["a"], "k"), "scorer", ["contains", "token_f1"], ["b", "a"], "s").collect()
    assert (by[0].k, by[0].k_by, by[1].k, by[2].k) == (["anna"], "capitals", None, None)
    assert by[0].s == pytest.approx(2 * 3 / 11) and by[0].s_by == "token_f1" and by[1].s == 0.0
    vectors = E.answer(rows, "embedder", ["letters"], ["a"], "e").collect()
    assert sum(x * x for x in vectors[0].e) == pytest.approx(1.0) and vectors[1].e is None and E.REGISTRY["embedder"].keys() >= {"hashed", "letters"}


def event(i, day, value=1.0, kind="a", hour=1):
    return (i, datetime.datetime(2024, 1, day, hour), 1, kind, value, None)


def frame(spark, *rows):
    from tessera.streaming.rollups import EVENTS

    return spark.createDataFrame(list(rows), EVENTS).coalesce(1)


def test_stream_after_a_restart_is_the_batch(spark, tmp_path):
    log, table, checkpoint = (f"file://{tmp_path}/{x}" for x in ("log", "table", "checkpoint"))
    parts = [[event(i, 1 + i % 5, i / 10, "ab"[i % 2]) for i in range(n, n + 20)] for n in (0, 20, 40)]
    for n, part in enumerate(parts):
        M.append_log(frame(spark, *part), log)
        M.run_rollup(spark, log, table, checkpoint, "30 days", files_per_batch=1)
        every = frame(spark, *[r for p in parts[: n + 1] for r in p])
        want = {(r.d, r.event_type, r.n, round(r.s / r.n, 6), r.m) for r in every.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("m")).collect()}
        assert {(r.window_start, r.event_type, r.n, round(r.avg_value, 6), r.max_value) for r in M.read_rollup(spark, table).collect()} == want
    M.run_rollup(spark, log, table, checkpoint, "30 days")
    assert {(r.window_start, r.event_type) for r in M.read_rollup(spark, table).collect()} == {w[:2] for w in want}


def test_late_rows_and_batches_written_twice(spark, tmp_path):
    log, table, checkpoint = (f"file://{tmp_path}/{x}" for x in ("log", "table", "checkpoint"))
    M.append_log(frame(spark, event(1, 1), event(2, 20)), log)
    M.run_rollup(spark, log, table, checkpoint, "3 days")
    M.append_log(frame(spark, event(3, 2, 5.0), event(4, 19, 7.0), (9, None, 1, "a", 1.0, None)), log)
    M.run_rollup(spark, log, table, checkpoint, "3 days")
    rows = {r.window_start.day: (r.n, r.max_value) for r in M.read_rollup(spark, table).collect()}
    assert rows == {1: (1, 1.0), 20: (1, 1.0), 19: (1, 7.0)}
    batches = sorted(os.listdir(f"{tmp_path}/table"))
    again = spark.read.schema(M.ROLLUP).parquet(f"file://{tmp_path}/table/{batches[0]}").cache()
    again.count()
    again.write.mode("overwrite").parquet(f"file://{tmp_path}/table/{batches[0]}")
    assert {r.window_start.day: (r.n, r.max_value) for r in M.read_rollup(spark, table).collect()} == rows
