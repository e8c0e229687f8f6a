"""WARC round trips and damage; neighbours against brute force; the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, warc

DATA = "/root/testdata/sf0.001"


def test_round_trip(spark):
    rows = [(1, "http://a", "x" * 40), (2, "http://b", "x" * 40), (3, "http://c", "ü"), (4, None, None), (5, "http://d\r\nWARC/1.1", ""), (None, "http://e", "x" * 40), (9, "http://f", "WARC/1.1\r\n\r\n\x1f\x8b\x08")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    folder = warc.archive_folder(spark)
    listed = warc.write_archives(pages, folder)
    records, gaps = warc.read_archives(spark, folder, with_payload=True)
    got = {r.page_id: r for r in records.collect()}
    assert gaps.count() == 0 and len(got) == len(rows) == listed.agg(F.sum("records")).first()[0]
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_bytes == 40 and got[1].payload_digest == warc.digest(b"x" * 40)
    assert got[2].record_type == "response" and bytes(got[2].payload) == b"x" * 40 and got[None].refers_to == 2
    assert got[4].record_type == "revisit" and got[4].refers_to == 5 and got[4].payload_bytes == 0
    assert got[3].payload_bytes == 2 and bytes(got[9].payload) == rows[-1][2].encode()
    whole = {r.page_id: r.record_type for r in (warc.write_archives(pages, f"{folder}-b", least_bytes=10), warc.read_archives(spark, f"{folder}-b")[0].collect())[1]}
    assert whole[4] == "response" and whole[5] == "response" and whole[1] == "revisit"


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_what_it_hits(packed):
    rng = random.Random(4)
    parts = [warc.record(i, f"http://{i}", bytes(rng.randrange(256) for _ in range(300))) for i in range(12)]
    parts = [warc.member(p) for p in parts] if packed else parts
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    data[starts[3] + len(parts[3]) // 2] ^= 0xFF
    data[starts[7] + 1] ^= 0xFF
    data = bytes(data[: starts[11] + 50])
    found = list(warc.salvage(data))
    pages = [int(f.fields["warc-page-id"]) for f in found if f.fields]
    assert pages == [0, 1, 2, 4, 5, 6, 8, 9, 10]
    gaps = [(f.offset, f.length) for f in found if f.reason]
    assert gaps == [(starts[3], len(parts[3])), (starts[7], len(parts[7])), (starts[11], 50)]
    assert [f.offset for f in found] == list(np.cumsum([0, *[f.length for f in found]])[:-1]) and sum(f.length for f in found) == len(data)
    assert list(warc.salvage(b"")) == []
    assert [f.length for f in warc.salvage(b"junk")] == [4]


def test_members_of_several_records_and_small_windows(monkeypatch):
    parts = [warc.record(i, f"http://{i}", bytes([65 + i]) * 300) for i in range(6)]
    broken = parts[1].replace(b"B" * 300, b"B" * 150 + b"X" * 150)
    data = warc.member(parts[0] + broken + parts[2]) + warc.member(parts[3] + parts[4]) + b"junk" + parts[5]
    for window in (64, 1 << 20):
        monkeypatch.setattr(warc, "WINDOW", window)
        found = list(warc.salvage(data))
        assert [int(f.fields["warc-page-id"]) for f in found if f.fields] == [0, 2, 3, 4, 5]
        assert [(f.length, f.reason) for f in found if f.reason] == [(0, "in a member: block digest differs"), (4, "no version line")]
        assert sum(f.length for f in found) == len(data)
    monkeypatch.setattr(warc, "LARGEST", 5000)
    bomb = warc.member(b"\0" * 100_000)
    assert [(f.reason, f.length) for f in warc.salvage(bomb + warc.member(parts[5]))][0] == ("no version line", len(bomb))


def test_an_archive_in_one_member_is_read_in_linear_time_and_bounded_memory(monkeypatch):
    """16,000 records of 2 kB; the bound on records is no bound on members, and a record beyond it costs itself only."""
    import time

    parts = [warc.record(i, f"http://{i}", random.Random(i % 7).randbytes(1500)) for i in range(16_000)]
    whole = warc.member(b"".join(parts))
    began = time.time()
    found = list(warc.salvage(whole))
    assert time.time() - began < 8
    assert [int(f.fields["warc-page-id"]) for f in found] == list(range(16_000)) and sum(f.length for f in found) == found[-1].length == len(whole)
    monkeypatch.setattr(warc, "LARGEST", 4000)
    large = warc.record(99, "http://large", b"y" * 9000)
    found = list(warc.salvage(warc.member(b"".join(parts[:100]) + large + b"".join(parts[100:200]))))
    assert [f.fields["warc-page-id"] for f in found if f.fields] == [str(i) for i in range(200)] and [f.reason for f in found if f.reason] == ["in a member: block too large"]


def test_records_in_front_of_damage_inside_a_member_stay():
    rng = random.Random(3)
    parts = [warc.record(i, f"http://{i}", rng.randbytes(3000)) for i in range(60)]
    whole, after = warc.member(b"".join(parts)), warc.member(warc.record(77, "http://after", b"z"))
    hit = bytearray(whole)
    hit[len(whole) // 2] ^= 0xFF
    for data in (bytes(hit), whole[: len(whole) // 2], whole[:-6] + b"\0\0\0\0\0\0"):
        found = list(warc.salvage(data + after))
        pages = [int(f.fields["warc-page-id"]) for f in found if f.fields]
        assert pages[-1] == 77 and pages[:-1] == list(range(len(pages) - 1)) and len(pages) > 25
        assert [(f.offset, f.length) for f in found if f.reason] == [(0, len(data))] and sum(f.length for f in found) == len(data + after)


def test_query_on_no_pages(spark, tmp_path):
    from tessera.llm.queries import op8_warc

    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert op8_warc(spark, f"file://{tmp_path}").collect() == []


def test_headers_of_a_revisit():
    made = warc.parse(warc.record(1, "http://a", b"x", 2, True, "http://b"))[0]
    assert made["warc-refers-to"] == warc.parse(warc.record(2, "http://b", b"x"))[0]["warc-record-id"] and made["warc-refers-to-target-uri"] == "http://b"


def exact(vectors, k):
    good = {i: np.array(v, dtype=float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 50 == 0:
            near = sorted((-float((good[q] * v).sum() / np.sqrt((good[q] ** 2).sum()) / np.sqrt((v**2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [i for _, i in near[:k]]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60 + i, [1.0] * 8) for i in range(20)]
    rows += [(100, None), (150, []), (200, [0.0] * 8), (250, [float("nan")] * 8), (300, [1.0, None] * 4), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (400, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, 5)
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 64)))]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows, 5)
    assert all(len(got[q]) == 5 for q in want)
    assert sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def odd_documents(spark, folder):
    """Texts that share ids, null ids, null and empty texts, repeated rows, copies and columns called like results."""
    words = lambda seed, n=60: " ".join(f"{random.Random(seed).choice('abcdefgh')}{random.Random(seed + i).randrange(500)}" for i in range(n))
    leak = words(900, 40)
    rows = [(1, words(10)), (1, words(20)), (2, words(30)), (3, words(10)), (None, words(40)), (None, words(40)), (None, words(20)), (4, None), (5, ""), (6, words(50) + " " + leak), (None, words(60) + " " + leak), (2, words(30)), (None, words(70))]
    docs = spark.createDataFrame([(i, t, "en", "s1", 0, "m", "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_note string, Size string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = odd_documents(spark, f"file://{tmp_path}")
    docs, stages = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    key = lambda r: (str(r[0]), str(r[1]))
    plain = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=key)
    assert plain(stages["toxicity"](spark, docs, f"file://{tmp_path}")) == sorted(rows, key=key)
    # Equal texts: the smallest id stays, rows without id after all others; texts that share an id stay both.
    kept = stages["near_duplicates"](spark, docs, f"file://{tmp_path}")
    wanted = sorted([rows[i] for i in (0, 1, 2, 4, 7, 8, 9, 10, 12)], key=key)
    assert plain(kept) == wanted and kept.columns == docs.columns
    clean = stages["decontamination"](spark, docs, f"file://{tmp_path}")
    assert plain(clean) == sorted([r for i, r in enumerate(rows) if i not in (9, 10)], key=key)
    done = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.text for r in done} <= {r[1] for r in rows if r[1]} | {r.text for r in done} and all(r.n_chars in (0, len(r.text)) for r in done)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0, name


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_pipeline_keeps_columns_and_order_of_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
    done = corpus_pipeline.run(spark, DATA)
    assert done.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"] and 0 < done.count() <= 2 * docs.count()
