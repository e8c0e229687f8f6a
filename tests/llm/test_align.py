"""Alignment of tokenizers against plain Python."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import align as A
from tessera.llm.queries import BYTE_LEVEL, VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_LEVEL), reason="no vocabularies")
TEXTS = [
    "The quick brown fox jumps over the lazy dog's back, 12345 times.", "Ærøskøbing naïve café — über", "<|endoftext|> <s></s> <unk> <0x0A> plain", "x▁y has the mark itself", "tabs\tand\nlines\r\n  spaces   end  ",
    "🙂🙃 日本語のテキスト", "a" * 700, " ", "  ", "\n", "\u0000 nul", "", None, "ﬁ ligature á", "word " * 3000, "ab" * 5000 + " " + "-" * 2000,
]


@pytest.fixture(scope="module")
def both():
    return A.loaded(A.ByteLevel, open(BYTE_LEVEL, "rb").read()), A.loaded(A.Pieces, open(VOCABULARY, "rb").read())


def slow(text, a, b):
    """(ids of A, ids of B, groups) by walking both sides; None if the bytes differ."""
    if not text:
        return None
    left, right, whole = a.slow.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text), (" " + text).encode()
    if b"".join(a.bytes[i] for i in left) != whole or b"".join(b.bytes[i] for i in right) != whole:
        return None
    groups, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
    while i < len(left) or j < len(right):
        if x <= y and i < len(left):
            x += len(a.bytes[left[i]])
            own[0].append(left[i])
            i += 1
        else:
            y += len(b.bytes[right[j]])
            own[1].append(right[j])
            j += 1
        if x == y:
            groups.append(own)
            own = ([], [])
    return left, right, groups


def spelled(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def test_ids_are_the_tokenizers_own(both):
    a, b = both
    assert a.fast is not None and b.by_word
    texts = [x for x in TEXTS if x]
    assert a.encode(texts) == [a.slow.encode(x, add_special_tokens=False).ids for x in texts]
    assert b.encode(texts) == [b.model.encode(x) for x in texts]
    long = "z" * (A.LONG_RUN + 5) + " end"
    assert a.encode([long]) == [a.slow.encode(long, add_special_tokens=False).ids]


def test_same_as_plain_python(spark, both):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é\n🙂.1 ") for _ in range(rng.randrange(40))) for _ in range(100)] + ["repeated row"] * 5
    docs = spark.createDataFrame([(i if i % 7 else None, x, "old", 1) for i, x in enumerate(texts)], "doc_id long, text string, N_A string, pairs int").repartition(3)
    found = A.align(docs, BYTE_LEVEL, VOCABULARY)
    assert found.columns == ["doc_id", "text", *A._MADE]
    from tessera.llm.common import store

    stored = store(found, "test-aligned")
    counts = store(A.link_counts(stored), "test-counts")
    want = {x: slow(x, *both) for x in texts}
    total = Counter((g[0][-1], g[1][-1]) for x in texts if want[x] for g in want[x][2])
    most = {}
    for (_, right), n in total.items():
        most[right] = max(n, most.get(right, 0))
    assert {((r.pair >> 32), r.pair & 0xFFFFFFFF): (r.n, r.best) for r in counts.collect()} == {p: (n, n == most[p[1]]) for p, n in total.items()}
    for shipped in (A.SHIPPED_PAIRS, 0):
        rows = A.value_links(stored, counts, shipped).collect()
        assert len(rows) == len(texts)
        for r in rows:
            if (w := want[r.text]) is None:
                assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == (0, 0, 0, 0, 0, 0, "")
                continue
            links = [(g[0][-1], g[1][-1]) for g in w[2]]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (len(w[0]), len(w[1]), len(w[2]), len(links), spelled(w[2]))
            assert (r.n_best, r.count_sum) == (sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    from tessera.llm.common import store

    stored = store(A.align(none, BYTE_LEVEL, VOCABULARY), "test-aligned")
    counts = store(A.link_counts(stored), "test-counts")
    assert counts.collect() == [] and A.value_links(stored, counts).collect() == [] and A.value_links(stored, counts, -1).collect() == []


def test_rank_and_select():
    rng = np.random.default_rng(0)
    for size in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(rng.random(size) < 0.3)
        bits = A.Bits.of(at, size)
        assert bits.select().tolist() == at.tolist()
        every = np.arange(size)
        assert bits.rank(every).tolist() == [int((at <= i).sum()) for i in every]
