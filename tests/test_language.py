"""Stems, keyphrases and ranks against plain Python."""

import math
import random
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stem
from tessera.functions import text as X
from tessera.operators import evaluate, graph, keywords

#: Words and their stems as published with the algorithm, and those of its common extension.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "sky": "sky", "skies": "sky", "dying": "die", "news": "news", "died": "die", "spied": "spi", "enjoy": "enjoy", "geologi": "geolog", "the": "the", "says": "say", "2024s": "2024",
}


def test_stems_are_the_published_ones(spark):
    rows = spark.createDataFrame([(list(STEMS),)], "ws array<string>").select(stem.stems("ws").alias("s")).first().s
    assert dict(zip(STEMS, rows, strict=True)) == STEMS


def test_stemmed_rouge(spark):
    rows = spark.createDataFrame([("The cats are running fast", "a cat runs"), ("", "x"), (None, None), ("Привет cat", "cats")], "a string, b string")
    got = [(round(r.rouge1, 4), r.rouge2, round(r.rouge_l, 4)) for r in evaluate.rouge_stemmed(rows, "a", "b").collect()]
    assert got == [(0.5, 0.0, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0)]


def test_paired_answers(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "s int, t int, answer string")
    b = spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "s int, t int, reference string")
    assert sorted((r.t, r.answer, r.reference) for r in evaluate.paired(a, b, ["s", "t"]).collect()) == [(1, "x", "p"), (2, "y", "q")]
    for left, right in ((a, b.limit(1)), (a.limit(1), b), (a.unionByName(a), b)):
        with pytest.raises(Exception, match="same turns"):
            evaluate.paired(left, right, ["s", "t"]).collect()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_keywords(text, top=10):
    parts = [s.strip(" \t\r\n\f") for s in re.sub(r"([.!?])[ \t\r\n\f]+", "\\1\x01", text or "").split("\x01")]
    sentences = [s for s in parts if s]
    seen, order = defaultdict(list), []
    for n, s in enumerate(sentences):
        for k, part in enumerate(re.split(r"[^\w \t\r\n\f]+", s)):
            ws = re.findall(r"\w+", part)
            for i, w in enumerate(ws):
                left, right = (ws[i - 1].lower() if i else None), (ws[i + 1].lower() if i + 1 < len(ws) else None)
                seen[w.lower()].append((n, w, left, right, k == 0 and i == 0))
                order.append((w.lower(), right))
    can = lambda w: len(w) > 2 and any(c.isalpha() for c in w) and w not in X.STOP_WORDS
    counts = [len(v) for w, v in seen.items() if can(w)]
    if not counts:
        return []
    mean, std, most, score = statistics.fmean(counts), statistics.pstdev(counts), max(map(len, seen.values())), {}
    for w, v in seen.items():
        if can(w):
            tf, lefts, rights = len(v), [x[2] for x in v if x[2] is not None], [x[3] for x in v if x[3] is not None]
            upper = sum(len(x[1]) > 1 and x[1].isalpha() and x[1].isupper() for x in v)
            title = sum(x[1][0].isupper() and not x[4] and not (len(x[1]) > 1 and x[1].isalpha() and x[1].isupper()) for x in v)
            t = 1 + ((len(set(lefts)) / len(lefts) if lefts else 0) + (len(set(rights)) / len(rights) if rights else 0)) * tf / most
            p = math.log(math.log(3 + statistics.median(x[0] for x in v)))
            score[w] = t * p / (max(upper, title) / (1 + math.log(tf)) + tf / (mean + std) / t + len({x[0] for x in v}) / len(sentences) / t)
    found = {w: s / (len(seen[w]) * (1 + s)) for w, s in score.items()}
    for (w, r), n in Counter((w, r) for w, r in order if r is not None and can(w) and can(r)).items():
        found[f"{w} {r}"] = score[w] * score[r] / (n * (1 + score[w] + score[r]))
    kept = []
    for s, k in sorted((round(s, 8), k) for k, s in found.items()):
        if len(kept) < top and not any(1 - edits(k, o) / max(len(k), len(o)) > 0.7 for _, o in kept):
            kept.append((s, k))
    return [(i, k, round(s, 6)) for i, (s, k) in enumerate(kept, 1)]


def test_keyphrases_are_those_of_the_slow_search(spark):
    rng = random.Random(6)
    vocabulary = ["Berlin", "berlins", "station", "stations", "NASA", "launch", "rocket", "the", "of", "été", "étés", "moon", "Moon", "orbit", "x1", "42", "rocketry", "long", "longer", "fuel_tank"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", ", ", "! ", " (", "; "]) for _ in range(rng.randrange(1, 90))) for _ in range(40)] + [None, "", "the of", "...", "One"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in keywords.keywords(docs).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r["rank"], r.keyword, round(r.score, 6)))
    assert {i: slow_keywords(t) for i, t in enumerate(texts) if slow_keywords(t)} == dict(got)


def test_ranks_converge_to_the_dense_solution(spark):
    rng = random.Random(3)
    n, damping = 30, 0.85
    edges = [(i, j, rng.random()) for i in range(n) for j in rng.sample(range(n), 3) if i % 10 and i != j]
    sources = [("a", 1), ("a", 2), ("b", 5), ("c", 10)]
    got = graph.pagerank_converged(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(sources, "q string, node long"), ["q"], tolerance=1e-5, most=200).collect()
    flow = np.zeros((n, n))
    for i, j, w in edges:
        flow[j, i] += w
    dead = flow.sum(axis=0) == 0
    flow[:, ~dead] /= flow[:, ~dead].sum(axis=0)
    for q in "abc":
        base = np.zeros(n)
        own = [s for p, s in sources if p == q]
        base[own] = 1 / len(own)
        want = np.linalg.solve(np.eye(n) - damping * (flow + np.outer(base, dead)), (1 - damping) * base)
        found = np.zeros(n)
        for r in got:
            if r.q == q:
                found[r.node] = r.ppr
        assert np.abs(found - want).sum() < 1e-4
    rounds = {r.q: r.rounds for r in got}
    assert rounds["c"] == 1 and 5 < rounds["a"] < 200
    capped = graph.pagerank_converged(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(sources, "q string, node long"), ["q"], tolerance=0.0, most=3).collect()
    assert {r.rounds for r in capped} == {3}


def test_edits_are_those_of_the_table():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(12))) for _ in range(60)]
    assert all(keywords.edits(a, b) == edits(a, b) for a in words for b in words)


def test_keyphrases_read_a_text_once(spark, capsys):
    """Words, their counts and pairs come from one reading of a text: nothing is joined or grouped after it is dealt, and rows of one id are one text."""
    docs = spark.createDataFrame([(1, "Red fox runs."), (2, "Lamp"), (1, "Red fox rests."), (None, "Oak"), (None, "Elm")], "doc_id long, text string")
    found = keywords.keywords(docs)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    rows = [(r.doc_id, r.keyword) for r in found.collect()]
    assert {(None, "elm"), (None, "oak"), (2, "lamp")} <= set(rows) and rows.count((1, "rests")) == 1 and rows.count((1, "red fox")) <= 1
