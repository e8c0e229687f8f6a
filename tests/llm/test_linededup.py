"""Shared lines against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import linededup as L

KINDS = "DOC_ID long, text string, n_lines string, extra int"


def slow(rows, least_chars=20, least_docs=3):
    held = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    place = lambda i: (i is not None, i or 0)
    for i, text, *_ in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if len(key(line)) >= least_chars:
                held[key(line)].add(place(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(held[key(x)]) >= least_docs and max(held[key(x)]) != place(i))]
        out.append((i, text, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = [f"Shared line number {i} that is long enough" for i in range(30)] + ["short one", "exactly twenty chars", "nineteen characters", "ÄÖÜäöü" * 4, "é" * 20, "é" * 19, " not ascii space around it "]
    line = lambda: rng.choice(["", " ", "\t\v", "\f\r"]) + (lambda x: x.upper() if rng.random() < 0.3 else x)(rng.choice(shared)) + rng.choice(["", " ", "\r"]) if rng.random() < 0.6 else "own " * 6 + str(rng.random())
    out = [(i, "\n".join(line() for _ in range(rng.randrange(0, 9))), "x", 0) for i in range(150)]
    out += [(1000 + i, "The hottest of all lines is in every document\n" + str(i) * 30, "x", 0) for i in range(400)]
    out += [(2000, None, "x", 0), (2001, "", "x", 0), (2002, "\n\n", "x", None), (None, "The hottest of all lines is in every document", "x", 0), (None, shared[0] + "\nno id but a long line", "x", 0)]
    return out + [(7, shared[1] + "\n" + shared[2], "x", 0)] * 3 + [(3000, "\n".join(f"{shared[i % 30]}" for i in range(40_000)), "x", 0)]


@pytest.mark.parametrize("most", [L.MOST_BITS, 1 << 13, 1 << 4])
def test_same_as_plain_python(spark, rows, most):
    """With a filter of the wanted size, with one that is nearly full, and without any."""
    docs = spark.createDataFrame(rows, KINDS).repartition(5)
    found = L.drop_shared_lines(docs, most_bits=most)
    assert found.columns == ["DOC_ID", "text", "extra", "n_lines", "n_dropped", "kept"]
    got = sorted(((r.DOC_ID, r.text, r.n_lines, r.n_dropped, r.kept) for r in found.collect()), key=str)
    assert got == sorted(slow(rows), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KINDS)
    assert L.drop_shared_lines(docs).collect() == []
    nothing = spark.createDataFrame([(1, None, "x", 0), (None, "", "x", 0)], KINDS)
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in L.drop_shared_lines(nothing).collect()) == [(1, 0, ""), (1, 0, "")]


def test_filters_miss_no_repeat_and_suspect_few_others():
    """Lines of two parts of which each has seen them once, and lines that one part has seen twice."""
    parts = [L.Filters(1 << 16), L.Filters(1 << 16)]
    one = lambda name, n: [L.digest(f"{name} {i}".encode()) for i in range(n)]
    for p, own in zip(parts, ("left", "right"), strict=True):
        p.add(one(own, 2000) + one("both", 100) + one(own + " again", 100))
        p.add(one(own + " again", 100))
    twice = parts[0].twice | parts[1].twice | (parts[0].once & parts[1].once)
    held = lambda names: L.holds(twice, parts[0].places(names))
    assert held(one("both", 100)).all() and held(one("left again", 100)).all() and held(one("right again", 100)).all()
    assert np.concatenate((held(one("left", 2000)), held(one("right", 2000)))).mean() < 0.1


def test_filter_grows_with_the_text_and_is_left_out_where_useless():
    assert L.filter_bits(0) == 1 << 13 and L.filter_bits(1 << 30) == 1 << 27 and L.filter_bits(1 << 34) == L.MOST_BITS
    assert L.filter_bits(L.MOST_BITS * L.USELESS + 1) is None
