"""Sharding and mixing against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, _r int")


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(3)
    out = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 120))), rng.choice(["en", "de"]), f"src{rng.randrange(5)}", "x", 0) for i in range(700)]
    hot = "copy of one text " * 6
    out += [(1000 + i, hot, "en", "src0", "x", 0) for i in range(500)]
    return out + [(5000, None, "en", "src1", None, 0), (5001, "", None, "src1", None, None), (None, "no id", "en", None, "x", 0), (7, "again", "en", "src0", "x", 0)] * 2


def test_shards_are_even_whole_and_gapless(spark, rows):
    import zlib

    found = sharding.assign_shards(docs_of(spark, rows), 8).collect()
    assert len(found) == len(rows)
    by, groups = defaultdict(list), defaultdict(list)
    for r in found:
        assert r["size"] == len((r.text or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
        by[r.shard].append(r)
        groups[r.text_crc32].append(r)
    total = sum(r["size"] for r in found)
    for s in range(8):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - total / 8) < 0.02 * total / 8 + 1200
    # One group is larger than a shard; all others are whole.
    sizes = {k: sum(r["size"] for r in g) for k, g in groups.items()}
    assert sorted(sizes.values())[-2] < total / 8 < max(sizes.values())
    assert all(len({r.shard for r in g}) == 1 for k, g in groups.items() if sizes[k] <= total / 8)
    assert len({r.shard for r in max(groups.values(), key=len)}) == -(-max(sizes.values()) * 8 // total)


def test_groups_up_to_a_shard_stay_whole(spark):
    """Groups of half a shard, which no law but wholeness would keep together, and small ones that fill up."""
    rows = [(100 * g + i, f"copy {g} " + "x" * 92, "en", "s", "x", 0) for g in range(6) for i in range(20)] + [(10000 + i, f"t{i} " + "y" * 40, "en", "s", "x", 0) for i in range(400)]
    found = sharding.assign_shards(docs_of(spark, rows), 8).collect()
    shards = defaultdict(set)
    for r in found:
        shards[r.text].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    sizes = [sum(r["size"] for r in found if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 300


def test_small_ranges_and_blocks_give_gapless_slots(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 2)
    found = sharding.assign_shards(docs_of(spark, rows), 5).collect()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    total = sum(r["size"] for r in found)
    for s in range(5):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - total / 5) < 0.02 * total / 5 + 1200


def test_shards_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, None, 1, 2, 3), (1, "", 1, 2, 3), (1, "", 1, 2, 3), (2, "long " * 50000, 1, 2, 3)], "doc_id long, text string, Size int, SHARD int, k int")
    found = sharding.assign_shards(frame, 24).collect()
    assert frame.columns[:2] + ["k"] == found[0].__fields__[:3] and sorted(r["size"] for r in found) == [8, 8, 8, 250008]
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert len({r.shard for r in found if r["size"] == 8}) == 1


def test_same_shards_each_time_and_empty_table(spark, rows):
    docs = docs_of(spark, rows[:600])
    once, twice = ({(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(d, 5).collect()} for d in (docs, docs.repartition(7)))
    assert once == twice
    assert sharding.assign_shards(docs.where("doc_id < 0"), 5).columns == ["doc_id", "text", "lang", "source", "_r", "size", "text_crc32", "shard", "slot"]
    assert sharding.assign_shards(docs.where("doc_id < 0"), 5).count() == 0


def fill(budget, nodes):
    """Level by level: share what is left by weight among those not full."""
    got, open_ = {n: 0.0 for n in nodes}, set(nodes)
    while open_ and budget > 1e-9:
        w = sum(nodes[n][1] for n in open_)
        full = {n for n in open_ if got[n] + budget * nodes[n][1] / w >= nodes[n][0] - 1e-12}
        if not full:
            for n in open_:
                got[n] += budget * nodes[n][1] / w
            break
        for n in full:
            budget -= nodes[n][0] - got[n]
            got[n] = nodes[n][0]
        open_ -= full
    return got


def test_budgets_go_to_siblings_first(spark, rows):
    docs = docs_of(spark, rows)
    langs = {"en": 1.0, "de": 3.0}
    chosen, leaves = mixing.mix(docs, F.lit("web"), F.col("lang"), F.col("source"), fraction=0.9, lang_weights=langs, max_epochs=2, seed=4)
    got = {(r.mix_domain, r.mix_lang, r.mix_source): r for r in leaves.collect()}
    caps = defaultdict(dict)
    for (d, l, s), r in got.items():
        caps[l][s] = (2 * r.tokens, 1.0)
    total = 0.9 * sum(r.tokens for r in got.values())
    top = fill(total, {l: (sum(c for c, _ in x.values()), langs.get(l, 1.0)) for l, x in caps.items()})
    for l, x in caps.items():
        for s, b in fill(top[l], x).items():
            assert got["web", l, s].budget == pytest.approx(b, abs=1e-6)
    taken, seen = defaultdict(int), defaultdict(list)
    for r in chosen.collect():
        key = (r.mix_domain, r.mix_lang, r.mix_source)
        taken[key] += r.mix_taken
        seen[key, r.mix_epoch].append(r)
        assert 0 < r.mix_taken <= r.mix_tokens == len((r.text or "").split())
    for key, r in got.items():
        assert taken[key] == pytest.approx(r.budget, abs=1)
        epochs = [e for k, e in seen if k == key]
        assert max(epochs) <= 1
        for e in range(max(epochs)):
            assert len(seen[key, e]) == r.rows


def test_mixing_nothing(spark, rows):
    docs = docs_of(spark, rows).where("doc_id < 0")
    assert mixing.mix(docs, F.lit("web"), F.col("lang"), F.col("source"))[0].count() == 0


def test_blocks_do_not_change_the_prefix(spark, rows, monkeypatch):
    docs = docs_of(spark, rows[:900])
    args = (F.lit("web"), F.col("lang"), F.col("source"))
    keys = lambda: sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in mixing.mix(docs, *args, fraction=0.4)[0].collect())
    large = keys()
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 7)
    assert keys() == large
