"""Ingest of folders, versions, and writers that get in each other's way."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.sources import chunks as C
from tessera.sources import ingest as I


def embed(rows):
    """Hashed counts in four buckets."""
    made = vectors.hashed_embedding(rows, "id", F.col("text"), 4).withColumn("embedding", F.col("embedding").cast("array<float>"))
    return rows.join(made, "id")


def write(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name.replace('__', '.')}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_a_folder_in_one_commit_and_its_next_version(spark, tmp_path):
    target = C.ChunkStore(spark, f"file://{tmp_path}/store")
    write(tmp_path / "in", a__txt="One two three. Four five six. Seven.", b__txt=b"caf\xe9 au lait.", c__xyz="no", d__docx=b"broken", e__txt=" ")
    rows = {r["name"]: r for r in I.ingest(target, f"file://{tmp_path}/in", "s", embed, 4).collect()}
    assert {n: (r.status, r.version) for n, r in rows.items()} == {"a.txt": ("success", 1), "b.txt": ("success", 1), "c.xyz": ("error", None), "d.docx": ("error", None), "e.txt": ("success", 1)}
    assert target.version() == 1 and rows["a.txt"].chunks_created > 1 and rows["e.txt"].chunks_created == 0
    have = target.read("s").collect()
    assert len(have) == rows["a.txt"].chunks_created + 1 and all(len(r.embedding) == 4 for r in have) and "café au lait." in {r.text for r in have}
    write(tmp_path / "next", a__txt="Now another text.")
    again = I.ingest(target, f"file://{tmp_path}/next", "s", embed).first()
    assert (again.version, again.previous_uuid, again.chunks_created) == (2, rows["a.txt"].document_uuid, 1) and target.version() == 2
    assert {r.text for r in target.read("s").collect()} == {"Now another text.", "café au lait."}
    assert {r.text for r in target.read("s", 1).collect()} == {r.text for r in have}
    assert {(r.name, r.version) for r in target.documents("s").collect()} == {("a.txt", 2), ("b.txt", 1), ("e.txt", 1)}
    I.ingest(target, f"file://{tmp_path}/next", "other", embed)
    assert target.delete_session("s") == 2 and target.read("s").count() == 0 and target.documents("s").count() == 0 and target.read().count() == 1
    assert I.ingest(target, f"file://{tmp_path}/next", "s", embed).first().version == 1
    with pytest.raises(ValueError, match="session"):
        I.ingest(target, f"file://{tmp_path}/in", "", embed)


def test_equal_names_and_scenarios(spark, tmp_path):
    target = C.ChunkStore(spark, f"file://{tmp_path}/store")
    write(tmp_path / "in/x", a__txt="first")
    write(tmp_path / "in/y", a__txt="second")
    rows = sorted((r.path[-7:], r.status, r.error) for r in I.ingest(target, f"file://{tmp_path}/in", "s", embed).collect())
    assert rows == [("x/a.txt", "error", "another file of this name"), ("y/a.txt", "success", None)]
    assert [r.text for r in target.read("s").collect()] == ["second"]
    told = spark.createDataFrame([("one", "x/a.txt", 3), ("two", "y/a.txt", None)], "name string, document string, chunk_size int")
    assert {(r.scenario, r.status, r.chunks_created) for r in I.ingest_scenarios(target, told, f"file://{tmp_path}/in", embed).collect()} == {("one", "success", 1), ("two", "success", 1)}
    assert I.ingest_scenarios(target, told.limit(0), "x", embed).collect() == []


def row(i, session="s", document="d"):
    return (f"{session}:{document}:{i}", f"t{i}", i, 1, [0.5], document, session)


def test_writers_in_each_others_way(spark, tmp_path):
    """Additions go on with the next number; a change worked out from an older version fails if its session was touched, and has no effect then."""
    target, other = (C.ChunkStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    frame = lambda *rows: spark.createDataFrame(list(rows), C.SCHEMA)
    assert target.add(frame(row(0), row(1), row(0, "t"))) == 3
    base = target.version()
    other.replace_document(frame(row(0, document="e")), "s", "d")
    with pytest.raises(C.Conflict):
        target.replace_document(frame(row(0, document="f")), "s", "d", base)
    assert {r.document_uuid for r in target.read("s").collect()} == {"e"}
    assert target.replace_document(frame(row(0, "t", "g")), "t", "d", base) == 1
    assert {r.document_uuid for r in target.read("t").collect()} == {"g"}
    number = target.version()
    files, at = target._files(f"log/{number + 1:012d}.json")
    files.create(at, False).close()
    with pytest.raises(C.Conflict):
        target.replace_document(frame(row(0, "t", "h")), "t", "g", number)
    assert other.add(frame(row(9, "u"))) == 1 and other.version() == number + 2 and other.read("u").count() == 1


def test_ingest_goes_again_after_a_conflict(spark, tmp_path):
    target = C.ChunkStore(spark, f"file://{tmp_path}/store")
    write(tmp_path / "in", a__txt="mine")
    calls = []

    def slow(rows):
        """Another writer ingests the same name meanwhile."""
        if not calls:
            calls.append(1)
            write(tmp_path / "else", a__txt="theirs")
            I.ingest(C.ChunkStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/else", "s", embed)
        return embed(rows)

    found = I.ingest(target, f"file://{tmp_path}/in", "s", slow).first()
    assert (found.version, found.chunks_created) == (2, 1) and [r.text for r in target.read("s").collect()] == ["mine"]
