"""Turns with exclusion against a fold over each session by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import turns as T

LISTS = "item_id long, doc_id long, narrow int, wide int, chunk_size int"


def first_places(pool, *_):
    """The first three of every pool."""
    return pool.where("place <= 3").withColumn("rank", F.col("place")).select("session", "turn", "item_id", "doc_id", "rank", "is_used", "chunk_size")


def fold(turns, lists, n, top, exclude=True, take=3):
    by_item, out = defaultdict(list), []
    for r in lists:
        by_item[r[0]].append(r)
    sessions = defaultdict(list)
    for s, t, i in turns:
        if s is not None:
            sessions[s].append((t, i))
    for s, own in sessions.items():
        used = []
        for t, i in sorted(own):
            rows = sorted((r[3], r[1]) for r in by_item[i]) if used and exclude else sorted((r[2], r[1]) for r in by_item[i] if r[2] is not None)
            new = [d for _, d in rows if d not in used] if exclude else [d for _, d in rows]
            old = [d for _, d in rows if d in used] if exclude else []
            pool = (new if len(new) >= n else new + old[: n - len(new)])[:top]
            out += [(s, t, i, d, rank, d not in used) for rank, d in enumerate(pool[:take], 1)]
            used += pool[:take]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    turns, lists, item = [], [], 0
    for s in range(12):
        for t in range(rng.randrange(1, 7)):
            docs = rng.sample(range(14), rng.randrange(0, 12))
            for w, d in enumerate(docs, 1):
                lists.append((item, d, w if w <= 6 else None, w, 10 * d))
            turns.append((s, 10 * t, item))
            item += 1
    turns += [(None, 0, item), (99, 0, item + 1), (50, 3, item + 2), (50, 3, item + 3)]
    lists += [(i, d, d + 1, d + 1, 1) for i in (item, item + 2, item + 3) for d in range(5)]
    return turns, lists


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize(("n", "top"), [(5, 20), (3, 4), (8, 6)])
def test_loop_is_the_fold_of_each_session(spark, data, n, top, exclude):
    turns, lists = data
    found = T.turn_loop(spark.createDataFrame(turns, "session long, turn int, item_id long"), spark.createDataFrame(lists, LISTS), first_places, n, top, exclude=exclude)
    got = sorted((r.session, r.turn, r.item_id, r.doc_id, r.rank, r.is_new) for r in found.collect())
    assert got == fold(turns, lists, n, top, exclude)


def test_statistics_and_empty_tables(spark):
    shown = spark.createDataFrame([(1, 0, 7, True, 10), (1, 0, 8, True, 20), (1, 2, 7, False, 10), (1, 2, 9, True, 5), (2, 0, 7, True, 10)], "session long, turn int, doc_id long, is_new boolean, chunk_size int")
    pool = spark.createDataFrame([(s, d) for s in (1, 2) for d in range(4, 12)], "session long, doc_id long")
    rows = {(r.session, r.turn): r for r in T.turn_statistics(shown, pool).collect()}
    r = rows[1, 2]
    assert (r.context_chunks_used, r.new_chunks, r.excluded_before, r.used_chunks, r.total_chunks, r.coverage_pct, r.context_tokens) == (2, 1, 2, 3, 8, 37.5, 15)
    assert rows[1, 0].excluded_before == 0 and rows[2, 0].used_chunks == 1
    none = T.turn_loop(spark.createDataFrame([], "session long, turn int, item_id long"), spark.createDataFrame([], LISTS), first_places, 5, 20)
    assert none.collect() == [] and "is_new" in none.columns


def test_graph_loop_shows_nothing_again_and_starts_as_a_single_search(spark):
    """In the first turn nothing is excluded, so the rerank chain sees what one search with the graph sees; later nothing that was shown comes again while new rows are left."""
    import os

    from tessera.config import modes
    from tessera.operators import scoring
    from tessera.plans import queries as Q

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test data")
    rows = Q.turn_loop_graph(spark, d).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.session, r.turn].append(r)
    assert rows and all(sorted(r.rank for r in own) == list(range(1, len(own) + 1)) for own in by.values())
    assert all(r.is_new for r in rows)
    lists = Q.turn_lists(spark, d).where("narrow <= 20").withColumnRenamed("semantic_score", "similarity_score").where("item_id % 4 = 0")
    first = Q.candidates(spark, d, lists).where("gated AND item_id % 4 = 0")
    want = scoring.rerank(first, ["item_id"], Q.SETTINGS, modes(Q.SETTINGS)["full"], Q.TURN_N)
    assert {(r.item_id, r.rank, r.doc_id) for r in want.collect()} == {(r.item_id, r.rank, r.doc_id) for r in rows if r.turn == 0}
