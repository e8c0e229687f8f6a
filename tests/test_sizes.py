"""Results at the edges of rounding, and steps whose memory and rows must not grow with pairs, against plain loops."""

import math
import random
from collections import Counter
from hashlib import md5
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, keywords, lexical, vectors
from tessera.plans import queries as Q


def test_concept_weights_have_no_guard(spark, tmp_path):
    """1 / sqrt(1 + 31^2 + 7^2 + 3^2 + 2^2) is 1 / 32, which is rounded up; a guard of 1e-8 makes it a little less."""
    buckets = {}
    for i in range(400):
        buckets.setdefault(int(md5(f"word{i}".encode()).hexdigest()[:8], 16) % 64, f"word{i}")
    words = list(buckets.values())[:5]
    text = " ".join(" ".join([w] * n) for w, n in zip(words, (1, 31, 7, 3, 2), strict=True))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.concept.split("_")[-1]: r.semantic_weight for r in Q.QUERIES["concept_weights"](spark, f"file://{tmp_path}").collect()}
    assert rows[words[0]] == 0.0313 and rows[words[1]] == 0.9688


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_edges_in_cells_and_fresh_ones(spark, monkeypatch, kind):
    """Several blocks, old and fresh ones, and one concept that all chunks have: pairs are as in a loop over all."""
    monkeypatch.setattr(graph, "BLOCK", 12)
    rng = random.Random(5)
    name = int if kind == "long" else "n{}".format
    held = {name(i): {"all"} | {f"w{rng.randrange(9)}" for _ in range(rng.randrange(4))} for i in range(70)}
    rows = spark.createDataFrame([(i, w, "KEYWORD", 1) for i, ws in held.items() for w in ws], f"doc_id {kind}, word string, type string, score long")
    want = {(min(a, b), max(a, b)): len(held[a] & held[b]) for a, b in combinations(held, 2) if len(held[a] & held[b]) > 1}
    found = [((r.a, r.b), r.shared) for r in graph.shared_edges(rows).collect()]
    assert len(found) == len(want) and dict(found) == want
    new = {name(i) for i in range(0, 70, 7)}
    found = [((r.a, r.b), r.shared) for r in graph.shared_edges(rows, fresh=spark.createDataFrame([(i,) for i in new], f"doc_id {kind}")).collect()]
    want_new = {p: n for p, n in want.items() if new & set(p)}
    assert len(found) == len(want_new) and dict(found) == want_new
    size = {i: 1 + n % 3 for n, i in enumerate(held)}
    apart, most = Counter(), Counter()
    for (a, b), n in want.items():
        for x, y in ((a, b), (b, a)):
            apart[x] += size[y]
            most[x] = max(most[x], n)
    found = graph.shared_counts(rows, spark.createDataFrame(list(size.items()), f"node {kind}, size long")).collect()
    assert {r.node: (r.apart, r.far) for r in found} == {i: (apart[i], max(0.1, 1 / (1 + most[i]))) for i in apart}


def test_pairs_of_chunks_are_not_shuffled(spark, capsys):
    rows = spark.createDataFrame([(i, w, "KEYWORD", 1) for i in range(9) for w in ("a", "b")], "doc_id long, word string, type string, score long")
    graph.both_ways(graph.shared_edges(rows), graph.SHARED).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_bm25_in_blocks_makes_no_rows_of_queries_and_texts(spark, monkeypatch, capsys):
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(lexical, "TEXTS_AT_ONCE", 3)
    rng = random.Random(3)
    texts = {i: [f"w{rng.randrange(12)}" for _ in range(rng.randrange(9))] for i in range(60)} | {60: ["rare"], 61: ["rare"]}
    asked = {q: [f"w{rng.randrange(14)}" for _ in range(4)] for q in range(5)} | {5: ["rare", "rare"], 6: ["nowhere"]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    found = lexical.bm25(spark.createDataFrame([(i, " ".join(t)) for i, t in asked.items()], "item_id long, text string"), docs, 4)
    df, n, avgdl = Counter(w for t in texts.values() for w in set(t)), len(texts), sum(map(len, texts.values())) / len(texts)
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = {}
    for q, words in asked.items():
        score = {i: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in words if w in t), 4) for i, t in texts.items() if set(words) & set(t)}
        want |= {(q, r): i for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:4], 1) if score[i] > 0}
    assert {(r.item_id, r.rank): r.doc_id for r in found.collect()} == want
    found.explain()
    assert "MapInArrow" in capsys.readouterr().out


def test_vector_search_in_small_pieces(spark, monkeypatch):
    """Each piece has one row; of equal vectors the smaller ids are taken, whichever piece they are in, and a task passes on k rows a query."""
    monkeypatch.setattr(vectors, "CELLS_AT_ONCE", 1)
    rng = random.Random(4)
    of = {i: [float(rng.randrange(3)), float(rng.randrange(3)), 1.0] for i in range(40)}
    rows = spark.createDataFrame(list(of.items()), "id long, v array<double>").orderBy(F.desc("id")).coalesce(1)
    found = vectors.exact_topk(rows.where("id % 10 = 0").withColumnsRenamed({"id": "q", "v": "w"}), rows, 3, "q", "w", "id", "v", not_same=True).collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / ((math.hypot(*a) + 1e-8) * (math.hypot(*b) + 1e-8)), 6)
    want = {(q, r): i for q in range(0, 40, 10) for r, i in enumerate(sorted((i for i in of if i != q), key=lambda i: (-cos(of[q], of[i]), i))[:3], 1)}
    assert {(r.q, r["rank"]): r.id for r in found} == want


def test_keyphrases_deal_texts_once(spark, capsys):
    docs = spark.createDataFrame([(1, "Red fox runs."), (1, "Red fox rests."), (2, None)], "doc_id long, text string")
    keywords.keywords(docs).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_ranks_and_distances_side_by_side(spark, monkeypatch):
    """Few parts stand in columns, many in rows; both ways have the same values, with dead ends and parts that end in different rounds."""
    rng = random.Random(6)
    edges = spark.createDataFrame([(a, b, rng.random()) for a in range(25) for b in rng.sample(range(30), 4)], "src long, dst long, weight double")
    sources = spark.createDataFrame([(p, rng.randrange(30)) for p in range(6) for _ in range(p + 1)] + [(0, 99)], "label long, node long")

    def every():
        made = [graph.distances(edges, sources, ["label"], 1.5), graph.pagerank(edges, sources, ["label"], 5), graph.pagerank_converged(edges, sources, ["label"], 30, 0.01)]
        assert [m.dtypes[0] for m in made] == [("label", "bigint")] * 3
        return [{(r[0], r[1]): tuple(r[2:]) for r in m.collect()} for m in made]

    wide = every()
    monkeypatch.setattr(graph, "WIDE", 0)
    for side, long in zip(wide, every(), strict=True):
        assert side.keys() == long.keys() and all(side[k] == pytest.approx(long[k], abs=1e-9) for k in long)
    assert len({r[1] for r in wide[2].values()}) > 1


def test_an_edge_is_taken_once_a_round(spark, capsys):
    """Ranks meet edges as a row a node, whatever the number of parts, and sums are not shuffled by part."""
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5)], "src long, dst long, weight double")
    sources = spark.createDataFrame([(p, 1) for p in range(5)], "label long, node long")
    graph.pagerank(edges, sources, ["label"], 2).explain()
    assert "Generate explode" in capsys.readouterr().out


def _few(spark, folder, n=60):
    """Tables with n documents of 12 words, of which the first hold the words of the items."""
    rng = random.Random(8)
    asked = [(i, " ".join(f"w{i}x{j}" for j in range(5)) + " the end") for i in range(8)]
    texts = [(i, f"{asked[i % 8][1] if i < 16 else ''} " + " ".join(f"v{rng.randrange(40)}" for _ in range(12))) for i in range(n)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def _stored(monkeypatch, f):
    """How often f stored a table of each name, and what it returned."""
    kept, real = Counter(), Q.store

    def stored(df, name, *done):
        kept[name] += 1
        return real(df, name, *done)

    monkeypatch.setattr(Q, "store", stored)
    found = f()
    return kept, found


def test_hashed_embedding_is_made_without_a_shuffle(spark, capsys):
    texts = [(1, "One two, two: three"), (2, ""), (3, None), (4, "Ünd ünd und"), (5, "a " * 3000)]
    df = vectors.hashed_embedding(spark.createDataFrame(texts, "id long, text string"), "id", F.col("text"), 8)
    df.explain()
    assert "Exchange" not in capsys.readouterr().out
    split = {1: "one two two three", 2: "", 3: "", 4: "ünd ünd und", 5: "a " * 3000}
    found = {r.id: r.embedding for r in df.collect()}
    for i, words in split.items():
        counts = Counter(int(md5(w.encode()).hexdigest()[:8], 16) % 8 for w in words.split())
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert found[i] == [counts[b] / norm if norm else 0.0 for b in range(8)]


def test_turn_lists_read_only_listed_texts_after_the_search(spark, tmp_path, monkeypatch):
    """The lexical search runs once for both depths, and what comes after the lists reads the texts that are in some list."""
    d = _few(spark, tmp_path, 400)
    monkeypatch.setattr(Q, "TURN_TOP", 3)
    kept, (pairs, texts) = _stored(monkeypatch, lambda: Q.turn_pairs(spark, d))
    assert kept["lexical-list"] == kept["turn-texts"] == kept["turn-lists"] == 1
    listed = {r.doc_id for r in pairs.collect()}
    assert {r.doc_id for r in texts.collect()} == listed and 0 < len(listed) <= 8 * 12 < 400


def test_containing_is_the_substring_of_normalized_texts(spark, monkeypatch, capsys):
    """First and last tokens of a phrase may be parts of words, short phrases have no inner token, an empty one is in every text; blocks of queries and batches of texts do not show."""
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(lexical, "TEXTS_AT_ONCE", 7)
    rng = random.Random(6)
    words = ["ab", "abc", "b", "ca", "cab", "x_1"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(90)] + [(90, None), (91, "AB, abc! b")]
    asked = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5])] + [(11, "b ca abc"), (12, None), (13, "b nowhere b")]
    df = lexical.containing(spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string"))
    plain = lambda t: " ".join((t or "").lower().replace(",", " ").replace("!", " ").split())
    want = sorted((q, i) for q, a in asked for i, t in texts if plain(a) in plain(t))
    assert sorted((r.item_id, r.doc_id) for r in df.collect()) == want
    capsys.readouterr()
    df.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_modes_are_searched_once(spark, tmp_path, monkeypatch):
    """Summaries ask for the lists and the judgements several times; both are stored, so that no search or check of texts runs again."""
    d = _few(spark, tmp_path)
    kept, found = _stored(monkeypatch, lambda: Q._compared(spark, d))
    assert kept["mode-lists"] == kept["relevance"] == 1
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.metric: r.base for r in found.collect()}.keys() == {"recall", "mrr", "coverage"}


def test_graph_of_turns_reads_only_listed_texts(spark, tmp_path, monkeypatch):
    """Concepts and vectors are made of the documents in some list; once the lists are there no round reads the table of documents."""
    d = _few(spark, tmp_path, 400)
    monkeypatch.setattr(Q, "TURN_TOP", 3)
    monkeypatch.setattr(Q, "turn_pairs", lambda *_, made=Q.turn_pairs(spark, d): made)
    monkeypatch.setattr(Q, "docs", lambda *_: pytest.fail("documents are read after the lists"))
    listed = {r.doc_id for r in Q.turn_pairs(spark, d)[1].collect()}
    seen, real = {}, Q.store

    def stored(df, name, *done):
        seen[name] = real(df, name, *done)
        return seen[name]

    monkeypatch.setattr(Q, "store", stored)
    found = Q.turn_loop_graph(spark, d)
    assert {r.doc_id for r in seen["turn-vectors"].collect()} == listed and {r.doc_id for r in seen["turn-concepts"].collect()} <= listed
    assert found.count() and {r.doc_id for r in found.collect()} <= listed


def test_graph_edges_link_different_texts_with_equal_concepts(spark, tmp_path):
    """Classes are by sets of concepts and not by texts, so an edge between members of one is not one between copies."""
    rows = [(1, "alpha beta gamma"), (2, "gamma beta alpha alpha"), (3, "alpha beta"), (4, None), (5, "alpha omega")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.src, r.dst): r.weight for r in Q.QUERIES["graph_edges"](spark, f"file://{tmp_path}").collect() if "concept" not in r.src + r.dst}
    pairs = {("1", "2"): 0.25, ("1", "3"): 0.3333, ("2", "3"): 0.3333}
    assert found == pairs | {(b, a): w for (a, b), w in pairs.items()}


@pytest.mark.parametrize("most", [1, 64])
def test_shared_ways_and_counts_of_frequent_and_rare_concepts(spark, monkeypatch, most):
    """More than 255 concepts in a chunk, and concepts that are kept as whole rows beside such that are kept as places."""
    monkeypatch.setattr(graph, "BLOCK", 100)
    monkeypatch.setattr(graph, "OFTEN", most)
    rng = random.Random(8)
    held = {i: {f"f{rng.randrange(3)}" for _ in range(2)} | {f"r{rng.randrange(60)}" for _ in range(4)} | ({f"x{k}" for k in range(300)} if i % 50 == 0 else set()) for i in range(210)}
    rows = spark.createDataFrame([(i, w, "KEYWORD", 1) for i, ws in held.items() for w in ws], "doc_id long, word string, type string, score long")
    want = {(str(a), str(b)): max(0.1, 1 / (1 + len(held[a] & held[b]))) for a in held for b in held if a != b and len(held[a] & held[b]) > 1}
    found = [((r.src, r.dst), r.weight) for r in graph.shared_ways(rows).collect()]
    assert len(found) == len(want) and dict(found) == want
    counted = {r.node: r.apart for r in graph.shared_counts(rows, spark.createDataFrame([(i, 1 + i % 2) for i in held], "node long, size long")).collect()}
    apart = Counter()
    for a, b in want:
        apart[int(a)] += 1 + int(b) % 2
    assert counted == apart


def test_concepts_of_texts_are_those_of_grouped_words(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["of", "the", "river", "Stone", "ÉCLAIR", "zz", "Mill", "paper,", "Lamp.", "größe", "x1"]) + rng.choice(["", "", "s", "9"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(60)] + [(60, None), (61, ""), (None, "red, Green green")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, graph.concepts_of_texts(docs).collect())) == sorted(map(str, graph.concepts(docs).collect()))


@pytest.mark.parametrize("cell", [7, 1000])
def test_similar_pairs_in_tiles_of_few_blocks(spark, monkeypatch, cell):
    """Tiles of a block meet each other once, and few vectors are not dealt over more blocks than hold them."""
    monkeypatch.setattr(vectors, "TILE", 4)
    rng = random.Random(2)
    of = {i: [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for i in range(60)}
    head = {tuple(v): i for i, v in sorted(of.items(), reverse=True)}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / ((math.hypot(*a) + 1e-8) * (math.hypot(*b) + 1e-8)), 6)
    want = {(a, b) for a, b in combinations(sorted(head.values()), 2) if cos(of[a], of[b]) > 0.35}
    found = [(r.a, r.b) for r in vectors.similar_pairs(spark.createDataFrame(list(of.items()), "vec_id long, embedding array<double>"), 0.35, cell=cell).collect()]
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("weights", [[0.25, 0.123457, 1.0], [1 / 3, 0.5, 1e7 / 3]])
def test_edges_by_target_are_lists_that_give_the_same_edges(spark, monkeypatch, weights):
    monkeypatch.setattr(graph, "PACKED", 10)
    rng = random.Random(4)
    rows = [(a, b, rng.choice(weights)) for a in range(20) for b in rng.sample(range(25), 5)] + [(1, 2, 0.5), (1, 2, 0.5)]
    dealt = graph.by_target(spark.createDataFrame(rows, "src long, dst long, weight double"))
    assert sorted(map(tuple, dealt.collect())) == sorted(rows) and graph.by_target(dealt) is dealt
    assert dealt.lists.count() < len(rows) and {r.node for r in graph.targets(dealt).collect()} == {b for _, b, _ in rows}
