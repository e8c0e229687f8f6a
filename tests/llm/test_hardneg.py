"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hardneg as H

KINDS = "vec_id long, embedding array<float>, label int, ID string"


def slow(rows, anchor=lambda i: i % 100 == 0):
    good = [(i, l, [max(-H.HELD, min(H.HELD, math.floor(256.0 * float(np.float32(c))))) for c in v]) for i, v, l, *_ in rows if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, l, v in good:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in good if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == l][:5]:
            near = [(n, k) for n, k, m in scored if m != l and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(near, 1)]
    return sorted(out)


def found(frame, **more):
    rows = H.mine(frame, F.col("vec_id") % 100 == 0, F.col("label"), **more)
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in rows.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vector = lambda i: [float(np.float32(c + rng.gauss(0, 0.4))) for c in centre[i % 5]]
    out = [(i, vector(i), rng.randrange(4), "x") for i in range(900)]
    out += [(2000 + i, centre[0], i % 3, "x") for i in range(300)]
    odd = [(5000, None, 1, "x"), (5100, vector(0), None, "x"), (5200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (5300, [float("nan")] * 6, 1, "x"), (5400, [float("inf")] + [0.0] * 5, 1, "x"), (None, vector(1), 1, "x")]
    return out + odd + [(5500, [0.0] * 6, 2, "x"), (5600, [1.0, 2.0], 1, "x"), (5601, [1.0, 1.5], 1, "x"), (5602, [0.5, 0.5], 2, "x"), (5700, [], 1, "x"), (5800, [-9.0] * 6, 3, None)]


@pytest.mark.parametrize("page", [8, 1024])
def test_same_as_plain_python(spark, rows, monkeypatch, page):
    monkeypatch.setattr(H, "PAGE", page)
    frame = spark.createDataFrame(rows, KINDS).repartition(4)
    assert found(frame) == slow(rows)


def test_far_pages_are_not_scanned(spark, monkeypatch):
    """Clusters far apart: the rings end before all pages are seen, and the result is that of the slow search."""
    monkeypatch.setattr(H, "PAGE", 16)
    monkeypatch.setattr(H, "FIRST", 2)
    rng = random.Random(2)
    rows = [(i, [float(np.float32(40.0 * (k == i % 30) + rng.gauss(0, 0.3))) for k in range(30)], (i // 30) % 2, "x") for i in range(1800)]
    frame = spark.createDataFrame(rows, KINDS)
    assert found(frame) == slow(rows)
    good = frame.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), H.whole(F.col("embedding")).alias("vector"))
    index = H.build(good)
    known = H.directory(index)[30]
    x = np.array([r.vector for r in good.where("id % 100 = 0").orderBy("id").collect()])
    least, most = H.bounds(x, known, index.pivots[30], index.square[30])
    every = np.array([r.vector for r in good.collect()])
    scores = np.sort(x @ every.T, axis=1)
    # A search for the ten best needs few of the pages; no page's bound is below a score that it holds.
    assert (most >= scores[:, -30:-29]).mean() < 0.2
    for p in index.pages.collect():
        own = np.frombuffer(p.vectors, "<i4").reshape(-1, 30).astype(np.int64)
        at = int(np.flatnonzero(known.page == p.page)[0])
        s = x @ own.T
        assert (s.max(axis=1) <= most[:, at]).all() and (s.min(axis=1) >= least[:, at]).all()


def test_ties_repeats_and_large_components(spark):
    same = [1.0, 2.0]
    rows = [(100, same, 0, "x"), *[(i, same, 0, "x") for i in range(1, 9)], *[(i, [0.5, 1.0], 1, "x") for i in range(20, 40)], (200, [3e38, -3e38], 0, "x"), (201, [3e38, 3e38], 0, "x"), (202, [1e38, -1e38], 1, "x"), (203, [9e4, -9e4], 1, "x"), (300, [3e38, -2.5e5], 2, "x")]
    assert found(spark.createDataFrame(rows, KINDS)) == slow(rows)
    twice = rows + [(5, same, 0, "x"), (25, [0.5, 1.0], 1, "x")]
    assert found(spark.createDataFrame(twice, KINDS)) == slow(twice)


def test_empty_tables_and_lone_anchors(spark):
    assert found(spark.createDataFrame([], KINDS)) == []
    assert found(spark.createDataFrame([(100, [1.0], 1, "x")], KINDS)) == []
    assert found(spark.createDataFrame([(100, [1.0], 1, "x"), (101, [1.0], 1, "x")], KINDS)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1, "x"), (2, [1.0], 2, "x")], KINDS)) == []
