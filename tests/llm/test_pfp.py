import hashlib
import random

import numpy as np
import pytest

from tessera.llm import pfp


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def sample():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60), text(80), text(45)]
    texts = ["", None, "short", "a" * 199, "a" * 200, "a" * 201, "ab" * 300, "xyz" * 500, text(400)]
    for _ in range(40):
        parts = [text(rng.randrange(5, 60))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 40)
            parts += [p[cut : len(p) - rng.randrange(0, 40)], text(rng.randrange(1, 30))]
        texts.append(" ".join(parts))
    edited = list(texts[-1])
    for _ in range(3):
        edited[rng.randrange(len(edited))] = "Q"
    return texts + ["".join(edited), texts[-2], texts[-2] + "!", texts[-3] + texts[-4]]


def found(spark, texts, length=200):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sorted(pfp.remove_repeats(docs, length=length).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def test_same_as_counting_all_strings(spark):
    texts = sample()
    assert found(spark, texts) == brute(texts, 200)


@pytest.mark.parametrize("length", [9, 300])
def test_other_lengths(spark, length, monkeypatch):
    monkeypatch.setattr(pfp, "BUCKET", 2)
    texts = sample()[:30] + ["ab" * 300 + "c"]
    assert found(spark, texts, length) == brute(texts, length)
    for wrong in (0, 5000):
        with pytest.raises(ValueError):
            pfp.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id int, text string"), length=wrong)


@pytest.mark.parametrize("bucket", [1, 3])
def test_triggers_with_many_entries_are_subdivided(spark, monkeypatch, bucket):
    monkeypatch.setattr(pfp, "BUCKET", bucket)
    monkeypatch.setattr(pfp, "BLOCK_BYTES", 2000)
    texts = sample()
    assert found(spark, texts) == brute(texts, 200)


def test_segments_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pfp, "SEGMENT", 300)
    texts = sample()[:30]
    assert found(spark, texts) == brute(texts, 200)


def test_ranks_are_those_of_sorted_suffixes():
    rng = random.Random(3)
    entries = ["".join(rng.choice("ab") for _ in range(rng.randrange(12, 60))).encode() for _ in range(30)]
    data = np.frombuffer(b"".join(entries), np.uint8)
    left = np.concatenate([np.arange(len(e), 0, -1) for e in entries])
    for length in (3, 8, 11, 12):
        rank = pfp.suffix_ranks(data, left, length)
        strings = {i: data[i : i + length].tobytes() for i in range(len(data)) if left[i] >= length}
        order = {x: n for n, x in enumerate(sorted(set(strings.values())))}
        assert all(rank[i] == (order[strings[i]] if i in strings else -1) for i in range(len(data)))


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "z" * 150 + "y" * 100, 1, 2)] * 2 + [(None, None, 1, 2)], "doc_id int, text string, h int, PLACE int")
    rows = sorted(pfp.remove_repeats(docs).collect(), key=lambda r: -r.n_bytes)
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in rows] == [(1, 250, 1), (1, 250, 1), (None, 0, 0)]
    assert pfp.remove_repeats(docs.where("doc_id > 1")).count() == 0
