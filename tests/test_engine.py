"""Hand-computed fixtures for each operator, and parity with SQL on small tables."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.config import PRESETS, ModeSpec, Settings, load_settings, modes
from tessera.functions import text as X
from tessera.operators import chunking, evaluate, fusion, graph, metrics, scoring, state, vectors
from tessera.sources import chunks as store_
from tessera.sources import files, sinks

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def text_docs(spark, *texts):
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")


def test_chunks_overlap_by_a_quarter_and_never_split_a_sentence(spark):
    nine = " ".join("w " * 29 + f"e{i}." for i in range(9))
    rows = chunking.chunk(text_docs(spark, nine, "x " * 149 + "y.", "", None), 100).orderBy("document_uuid", "chunk_index").collect()
    sizes = [(r.document_uuid, r.chunk_index, r.chunk_size) for r in rows]
    assert sizes == [("0", 0, 90), ("0", 1, 90), ("0", 2, 90), ("0", 3, 90), ("1", 0, 150)]
    assert rows[1].text.split(".")[0].endswith("e2") and rows[0].id == "en:0:0"


def test_versions(spark):
    up = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("t", "a", 4)], "s string, n string, u long")
    rows = {r.u: (r.version, r.previous_uuid) for r in chunking.versions(up, "s", "n", ["u"], "u").collect()}
    assert rows == {1: (1, None), 2: (2, 1), 3: (1, None), 4: (1, None)}


def test_fusion_adds_weights_over_ranks(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q long, d string, rank int")
    rows = fusion.reciprocal_rank_fusion([(a, 0.6), (b, 0.4)], 30, ["q"], "d").orderBy("rank").collect()
    assert [r.d for r in rows] == ["y", "x", "z"]
    assert rows[0].rrf_score == pytest.approx(0.6 / 32 + 0.4 / 31)
    assert fusion.pool_size(5, False) == 20 and fusion.pool_size(10, True) == 60
    assert [r.d for r in fusion.hybrid(a, b, 0.0, 30, ["q"], "d", 9).orderBy("rank").collect()] == ["x", "y"]


def candidates(spark, rows, query="Tell me"):
    return spark.createDataFrame([(1, i, query, t, s, d) for i, (t, s, d) in enumerate(rows)], "q long, doc_id long, query string, text string, semantic_score double, distance double")


@pytest.mark.parametrize(("best", "alone"), [(0.39, True), (0.40, False)])
def test_low_semantic_scores_drop_the_graph(spark, best, alone):
    rows = candidates(spark, [("a", best, 1.0), ("b", 0.2, None), ("c", 0.1, 3.0)])
    got = {r.doc_id: r for r in scoring.hybrid_score(rows, ["q"], Settings(), modes()["graph_nofilter"]).collect()}
    assert got[0].alpha == (1.0 if alone else 0.7)
    assert got[1].graph_score == pytest.approx(1 / 101)
    assert got[0].hybrid_score == pytest.approx(best if alone else 0.7 * best + 0.3 * 0.5, abs=1e-6)


def test_boost_anchor_and_classes(spark):
    mode = ModeSpec("m", True, 0.4, dynamic_weights=True, anchor=True, boost=True)
    rows = candidates(spark, [("the void", 0.5, 1.0), ("void deep mind stone", 0.5, 1.0), ("x", 0.71, 1.0)], "What? deep void mind stone")
    got = {r.doc_id: r for r in scoring.hybrid_score(rows, ["q"], Settings(), mode).collect()}
    base = 0.85 * 0.5 + 0.15 * 0.5
    assert got[0].query_type == "factual" and got[0].hybrid_score == pytest.approx(base, abs=1e-6)
    assert got[1].hybrid_score == pytest.approx(base + 0.12, abs=1e-6) and got[2].hybrid_score == 0.8
    assert one(spark, X.keyword_words(F.lit("What? is the Void? void!"))) == ["what", "void"]
    kinds = ["Почему так?", "Who did it", "showhow", "impact of rain", "сколько стоит"]
    assert [one(spark, X.query_class(F.lit(k))) for k in kinds] == ["complex", "factual", "default", "complex", "factual"]


def ranked(spark, scores):
    return spark.createDataFrame([(1, i, i + 1, s) for i, s in enumerate(scores)], "q long, doc_id long, rank int, final_score double")


def test_adaptive_cut(spark):
    scores = [1, 0.9, 0.8, 0.7, 0.6, 0.05, 0.04]
    for k, left in ((5, 5), (7, 5)):
        assert scoring.adaptive_cut(ranked(spark, map(float, scores)), ["q"], k, Settings()).count() == left
    assert scoring.adaptive_cut(ranked(spark, [1.0, 0.1, 0.1]), ["q"], 2, Settings()).count() == 3
    assert scoring.adaptive_cut(ranked(spark, [-1.0] * 8), ["q"], 5, Settings()).count() == 8
    assert scoring.adaptive_cut(ranked(spark, [1.0, 0.9, 0.9, 0.9, 0.9, 0.9, 0.35, 0.34]), ["q"], 8, Settings()).count() == 6


def test_blend_scales_the_head_only_and_padding_fills_up(spark):
    rows = spark.createDataFrame([(1, i, i + 1, 0.9 - i / 10, c) for i, c in enumerate([0.1, 0.5, 0.3, 9.0])], "q long, doc_id long, rank int, hybrid_score double, ce double")
    got = scoring.blend_reranked(rows, ["q"], "ce", 3, 0.5).orderBy("rank").collect()
    assert [(r.doc_id, r.cross_encoder_score) for r in got] == [(1, 1.0), (2, pytest.approx(0.5)), (0, 0.0), (3, -1.0)]
    flat = scoring.blend_reranked(rows.withColumn("ce", F.lit(0.2)), ["q"], "ce", 3, 0.5).where("rank <= 3").collect()
    assert {r.cross_encoder_score for r in flat} == {1.0}
    all_rows = ranked(spark, [0.5] * 8)
    padded = scoring.pad(all_rows.where("rank <= 2"), all_rows, ["q"], "doc_id", 6).orderBy("rank").collect()
    assert [(r.doc_id, r.padded) for r in padded] == [(0, False), (1, False), (2, True), (3, True), (4, True), (5, True)]


def test_baseline_filter_and_budget(spark):
    rows = spark.createDataFrame([(1, 1, 0.1, "a" * 40), (1, 2, None, "b" * 40), (2, 1, 0.1, "c" * 400), (2, 2, 0.1, "d")], "q long, rank int, similarity_score double, text string")
    assert {(r.q, r["rank"]) for r in scoring.baseline_filter(rows, ["q"], 0.5).collect()} == {(1, 2), (2, 1)}
    assert {(r.q, r["rank"]) for r in scoring.prompt_budget(rows, ["q"], 25).collect()} == {(1, 1), (1, 2)}


def edges_of(spark, rows):
    return spark.createDataFrame([x for a, b, w in rows for x in ((a, b, w), (b, a, w))], "src string, dst string, weight double")


def test_distances_norms_and_ranks(spark):
    edges = edges_of(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.5), ("c", "d", 2.5), ("x", "y", 0.1)])
    start = spark.createDataFrame([(1, "a")], "q long, node string")
    found = {r.node: r.distance for r in graph.distances(edges, start, ["q"]).collect()}
    assert found == {"a": 0.0, "b": 1.0, "c": 2.0}
    table = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", 999.0), (2, "a", 2.0), (2, "b", 2.0), (3, "a", 999.0)], "q long, node string, distance double")
    assert {(r.q, r.node): r.normalized for r in graph.normalized_distances(table, ["q"]).collect()} == {(1, "a"): 0.0, (1, "b"): 1.0, (1, "c"): 0.8, (2, "a"): 0.0, (2, "b"): 0.0, (3, "a"): 0.8}
    ranks = graph.pagerank(edges, start, ["q"], 30).collect()
    assert sum(r.ppr for r in ranks) == pytest.approx(1.0) and max(ranks, key=lambda r: r.ppr).node in ("a", "c")
    near = graph.neighbours(edges, start, ["q"], 5).orderBy("rank").collect()
    assert [(r.node, r.weight) for r in near] == [("b", 1.0), ("c", 2.5)]


def test_edge_cutoff_interpolates(spark):
    edges = spark.createDataFrame([("a", str(i), w) for i, w in enumerate([0.1, 0.2, 0.3, 0.35])], "src string, dst string, weight double")
    rows = graph.edge_cutoff(edges, 0.55).collect()
    assert {r.weight for r in rows} == {0.1, 0.2} and rows[0].cutoff == pytest.approx(0.265)


def test_shared_edges_count_common_concepts(spark):
    rows = [(1, w) for w in "abcd"] + [(2, w) for w in "bcde"] + [(3, w) for w in "az"] + [(4, w) for w in "de"]
    mentions = spark.createDataFrame([(i, w, "KEYWORD", 1) for i, w in rows], "doc_id long, word string, type string, score long")
    assert {(r.a, r.b, r.shared, round(r.weight, 4)) for r in graph.shared_edges(mentions).collect()} == {(1, 2, 3, 0.25), (2, 4, 2, 0.3333)}
    assert one(spark, X.concept_word(F.lit("concept_NER_PERSON_jean_luc"))) == "jean_luc"


def test_rank_metrics(spark):
    got = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q long, d string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (2, "z")], "q long, d string")
    rows = {(r.q, r.k): r for r in evaluate.rank_metrics(got, rel, ["q"], "d", (2, 5)).collect()}
    assert rows[1, 2].recall == pytest.approx(1 / 3) and rows[1, 2].precision == 0.5 and rows[1, 5].precision == 0.4
    assert rows[1, 5].ap == pytest.approx((1 + 2 / 3) / 3) and rows[1, 5].mrr == 1.0 and rows[1, 5].hit == 1
    assert rows[1, 5].ndcg == pytest.approx((1 + 0.5) / (1 + 0.6309297535714575 + 0.5))
    assert rows[2, 5].recall == 0.0 and rows[2, 5].mrr == 0.0 and rows[2, 5].f1 == 0.0
    with pytest.raises(ValueError):
        evaluate.rank_metrics(got, rel, ["q"], "d", (0,))


def test_evidence_and_answers(spark):
    ev = spark.createDataFrame([(1, 0, "the old red door"), (1, 1, "nothing like it")], "q long, evidence_no int, evidence string")
    got = spark.createDataFrame([(1, 1, "a blue wall"), (1, 2, "see the OLD, red door here")], "q long, rank int, text string")
    row = evaluate.evidence_metrics(ev, got, ["q"]).first()
    assert (row.recall, row.hit, row.mrr, row.ap) == (0.5, 1, 0.5, 0.25)
    assert one(spark, evaluate.evidence(F.array(F.lit(" A b"), F.lit("a B"), F.lit(""), F.lit("c")))) == ["A b", "c"]
    assert one(spark, X.token_f1(F.lit("a b b c"), F.lit("b b d"))) == pytest.approx(4 / 7)
    assert one(spark, evaluate.exact_match(F.lit("A, b"), F.lit("a b"))) == 1 and one(spark, evaluate.exact_match(F.lit(""), F.lit(""))) == 0
    pair = spark.createDataFrame([("the cat sat on the mat", "the cat on a mat"), ("", "x")], "a string, b string")
    assert [r[0] for r in pair.select(evaluate.rouge_l(F.col("a"), F.col("b"))).collect()] == [pytest.approx(8 / 11), 0.0]
    assert one(spark, evaluate.rouge_n(F.lit("a b c"), F.lit("b c d"), 2)) == pytest.approx(0.5)


def test_comparison_and_verdict(spark):
    rows = spark.createDataFrame([("b", "recall", 0.5), ("f", "recall", 0.6), ("b", "latency", 10.0), ("f", "latency", 8.0), ("b", "coverage", 0.0), ("f", "coverage", 0.1), ("b", "accuracy", 1.0), ("f", "accuracy", 0.9)], "mode string, metric string, value double")
    got = {r.metric: (r.delta, r.improvement_pct) for r in evaluate.compare(rows, "b", "f").collect()}
    assert got == {"recall": (0.1, 20.0), "latency": (2.0, 20.0), "coverage": (0.1, 0.0), "accuracy": (-0.1, -10.0)}
    row = evaluate.verdict(evaluate.compare(rows, "b", "f")).first()
    assert (row.recall, row.accuracy, row.overall) == ("improved", "worse", "improved")


def test_metrics(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "p int, o int, v double")
    assert metrics.latency_summary(rows, ["p"], "v", "o").first().p95_value == 19.0
    assert rows.agg(metrics.p95(F.col("v"))).first()[0] == 19.0
    counter = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 7.0), (1, 4, None)], "p int, o int, v double")
    assert [r.delta for r in metrics.counter_delta(counter, ["p"], ["o"], "v").orderBy("o").collect()] == [0.0, 0.0, 4.0, 0.0]
    lines = spark.createDataFrame([("# x",), ('vllm:hits_total{a="1",b="x y"} 3.5',), ('vllm:hits_total{a="2"} 1e1',), ("bad line here",), ("up 1",)], "line string")
    parsed = metrics.parse_samples(lines)
    assert {(r.name, r.value) for r in metrics.sample_sums(parsed).collect()} == {("hits_total", 13.5), ("up", 1.0)}
    assert parsed.where("value = 3.5").first().labels == {"a": "1", "b": "x y"}
    ev = spark.createDataFrame([("s", 1, "start", 1, 5.0), ("s", 1, "start", 2, 6.0), ("s", 1, "end", 3, 9.0), ("s", 2, "end", 4, 1.0)], "session string, i int, event string, ts int, value double")
    assert {(r.i, r.event, r.delta) for r in metrics.pair_events(ev, ["session", "i"]).collect()} == {(1, "end", 4.0), (2, "end_no_start", 0.0)}


def test_state(spark):
    use = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "a"), ("s", 3, "c")], "s string, i int, c string")
    pool = spark.createDataFrame([("s", x) for x in "abcd"], "s string, c string")
    assert [(r.i, r.used_chunks, r.coverage_pct) for r in state.coverage_curve(use, pool, "s", "i", "c").orderBy("i").collect()] == [(1, 2, 50.0), (2, 2, 50.0), (3, 3, 75.0)]
    assert [r.c for r in state.unused(pool, use, ["s"], "c").collect()] == ["d"]
    cache = state.Cache(capacity=2, preload=2)
    cache.start(["a", "b", "c"])
    assert cache.turn(["a", "b"])["hits"] == 2
    assert cache.turn(["c"])["action"] == "offload" and cache.hot == []
    assert cache.turn(["c"])["action"] == "load" and cache.hot == ["c"]


def test_vector_search(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>")
    q = rows.where("vec_id = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    assert [r.vec_id for r in vectors.exact_topk(q, rows, 2, "q", "v", "vec_id", "embedding", not_same=True).orderBy("rank").collect()] == [1, 3]
    assert {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9, cell=1).collect()} == {(0, 1)}


def test_ids_languages_and_tokens(spark):
    got = [one(spark, X.chunk_number(F.lit(x))) for x in ("s:u:3", "chunk_001", "chunk_x", "foo")]
    assert got == ["3", "0", "chunk_x", "foo"]
    assert one(spark, X.language(F.lit("Привет, мир"))) == "ru" and one(spark, X.language(F.lit("Guten Tag"))) == "en"
    assert one(spark, X.output_tokens(F.lit(128), F.lit(100), F.lit(50))) == 34 and one(spark, X.output_tokens(F.lit(128), F.lit(100), F.lit(200))) == 16


def docx(paragraphs, table):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    body = "".join(map(p, paragraphs)) + f"<w:tbl>{rows}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_bytes("größe".encode())
    (d / "b.TXT").write_bytes("größe".encode("latin-1"))
    (d / "c.docx").write_bytes(docx(["one", "", "two"], [["x", "y"]]))
    (d / "d.docx").write_bytes(b"broken")
    (d / "e.doc").write_bytes(b"old")
    rows = {r.name: r for r in files.read_documents(spark, str(d)).collect()}
    assert rows["a.txt"].text == rows["b.TXT"].text == "größe" and rows["c.docx"].text == "one\ntwo\nx | y"
    assert rows["d.docx"].status == "error" and rows["e.doc"].error == "unsupported suffix .doc"
    s = tmp_path / "s"
    s.mkdir()
    (s / "x.json").write_text(json.dumps({"name": "n", "document": "a.txt", "chunk_size": 100, "turns": [{"query": "q", "ground_truth_chunks": [], "ground_truth": ["chunk_001"]}, {"query": "r", "ground_truth_chunks": ["c"], "ground_truth_text": "p"}]}))
    head, turns = files.read_scenarios(spark, str(s))
    assert head.first().chunk_overlap == 12 and [r.ground_truth for r in turns.orderBy("turn").collect()] == [["chunk_001"], ["c"]]
    assert files.list_stems(spark, str(s)).first().name == "x"
    for n in ("x_1.json", "x_comparison_1.json"):
        (s / n).write_text("{}")
    assert files.latest_result(spark, str(s), "x").first().path.endswith("x_comparison_1.json")


def test_store_and_sinks(spark, tmp_path):
    rows = [("s:1:0", "a", 0, 1, [1.0], "1", "s"), ("s:1:1", "b", 1, 1, [1.0], "1", "s"), ("t:2:0", "c", 0, 1, [1.0], "2", "t")]
    table = store_.ChunkStore(spark, f"file://{tmp_path}/chunks")
    assert table.read().count() == 0
    frame = spark.createDataFrame(rows, store_.SCHEMA)
    assert table.add(frame) == 3 and table.info()["count"] == 3
    with pytest.raises(ValueError):
        table.add(frame.withColumn("document_uuid", F.lit(None).cast("string")))
    assert table.delete_ids("s", ["s:1:0"]) == 1 and table.read("s").count() == 1
    assert table.replace_document(frame.where("session_id = 's'").withColumn("document_uuid", F.lit("9")), "s", "1") == 1
    assert {r.document_uuid for r in table.read("s").collect()} == {"9"} and table.delete_document("s", "9") == 2
    assert table.delete_session("t") == 1 and table.read().count() == 0
    sinks.write_csv([frame.select("id"), frame.select("text")], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "text"]
    assert not sinks.write_snapshot(frame.limit(0), frame, str(tmp_path / "g"), "t1") and sinks.write_snapshot(frame.select("id"), frame.select("id"), str(tmp_path / "g"), "t1")
    assert files.read_snapshot(spark, str(tmp_path / "g/latest"))[0].count() == 3
    assert "<td>s:1:0</td>" in sinks.html_report("t", {"a": "<1>"}, frame.select("id").orderBy("id")) and "&lt;1&gt;" in sinks.html_report("t", {"a": "<1>"}, frame.select("id"))


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"rrf_k": 7, "unknown": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert load_settings(str(tmp_path / "c.json")).rrf_k == 7 and load_settings(str(tmp_path / "bad.json")) == Settings() == load_settings(str(tmp_path / "none"))
    assert modes(Settings(bm25_weight=0.0))["hybrid_rag"].bm25_weight == 0.4 and PRESETS["max"].min_return == 6


FAST = [
    "question_distance", "retrieve_full", "graph_stats", "node_info", "graph_update", "inverted_index", "concept_weights", "bm25_idf",
    "token_counts", "sentences", "chunks", "chunk_stats", "session_docs", "query_class", "evidence_dedup", "doc_versions", "bm25_topk", "vector_topk_filtered", "similar_pairs", "concepts", "concept_edges",
    "edge_cutoff", "degree_topk", "recall_at_k", "token_f1", "rouge2", "counter_delta", "latency_summary", "moving_avg", "kv_pairs", "prom_parse", "coverage_curve", "unused_chunks", "stream_latency", "coverage_history", "answer_similarity", "turn_scores", "stream_sessions",
    "keyphrases", "rouge_l", "rouge_stemmed", "answer_accuracy", "similar_texts", "corpus_graph", "corpus_update", "run_report", "mode_comparison", "performance_report", "embedder_chain", "scorer_chain", "stream_rollup", "retrieve_fallbacks", "turn_loop",
]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from tessera.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda v: "" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else f"{v:.4f}" if isinstance(v, float) else str(v).removesuffix(".0")
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert [tuple(x.rstrip("0").rstrip(".") if "." in x else x for x in r) for r in rows(ours)] == [tuple(x.rstrip("0").rstrip(".") if "." in x else x for x in r) for r in rows(theirs)]


def test_streams(spark, tmp_path):
    from tessera.streaming import rollups

    rows = [(i, f"2024-01-0{1 + i // 4} 00:{10 * (i % 4):02}:00", i % 2, "view", float(i), "{}") for i in range(8)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = rollups.read_events(spark, str(tmp_path / "e"))
    got = rollups.run_to_table(rollups.windowed(stream), "windows_test").collect()
    assert sorted((r.n, r.avg_value) for r in got) == [(4, 1.5), (4, 5.5)]
    turns = rollups.read_events(spark, str(tmp_path / "e")).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("iteration"), F.array("event_type").alias("wanted"))
    state_rows = rollups.run_to_table(rollups.cache_stream(turns), "cache_test", "append").collect()
    assert len(state_rows) == 8 and sum(r.hits for r in state_rows) == 6


def test_budget_from_error_and_prefetch(spark):
    said = "maximum context length is 4096 tokens, your prompt contains at least 4000 input tokens"
    assert one(spark, X.retry_budget(F.lit(said))) == 80 and one(spark, X.retry_budget(F.lit(said.replace("4000", "4090")))) is None and one(spark, X.retry_budget(F.lit("no"))) is None
    assert one(spark, X.trigrams(F.lit("abcd"))) == "abc bcd" and one(spark, X.trigrams(F.lit("ab"))) == "ab"
    cache = state.Cache(capacity=3, preload=1)
    cache.start(["a", "b", "c", "d"])
    assert cache.prefetch(["c", "x"], ["a"], 2) == ["c"] and cache.prefetch([], ["a"], 2) == ["b"]
    assert cache.evict(["d", "a"], 5.0, 9.0) == 0 and cache.evict(["d", "a"], 9.0, 9.0) == 1 and "d" not in cache.cold


def test_expansion_gate_and_concept_match(spark):
    edges = edges_of(spark, [("1", "2", 0.2), ("1", "3", 0.3)])
    cands = spark.createDataFrame([(7, "1", 0.9)], "q_id long, vec_id string, similarity_score double")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "q_id long, q array<double>")
    vecs = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 1.0]), ("3", [0.1, 1.0])], "vec_id string, embedding array<double>")
    from tessera.functions import vectors as V

    assert [r.vec_id for r in graph.expand(cands, edges, asked, vecs, "q_id", V.cosine).collect()] == ["2"]
    assert graph.expand(cands, edges, asked, vecs, "q_id", V.cosine, gate=False).count() == 2
    words = spark.createDataFrame([(1, "known"), (1, "close"), (1, "far")], "q_id long, word string")
    near = spark.createDataFrame([("close", "known", 0.6), ("far", "known", 0.1)], "word string, concept string, similarity_score double")
    found = graph.match_concepts(words, spark.createDataFrame([("known",)], "word string"), lambda w, c: near, "q_id").collect()
    assert {(r.word, r.concept, r.kind) for r in found} == {("known", "known", "exact"), ("close", "known", "fuzzy")}


def test_packing_matches_the_definition():
    import random

    rng = random.Random(1)
    for _ in range(100):
        words, most = [rng.randrange(0, 40) for _ in range(rng.randrange(0, 30))], rng.randrange(1, 60)
        got, start = [], 0
        for i in range(1, len(words) + 1):
            if sum(words[start:i]) > most and i - 1 > start:
                got.append((start, i - 1, sum(words[start : i - 1])))
                start = i - 1 - max(1, (i - 1 - start) // 4)
        assert chunking.pack(words, most) == ([*got, (start, len(words), sum(words[start:]))] if words else [])


def test_exact_quantile_with_a_bracket(spark):
    """Parts large enough for a bracket, with ties, a null part and null values."""
    import random

    rng = random.Random(2)
    rows = [("a", i, float(rng.randrange(300))) for i in range(5000)] + [(None, i, rng.random()) for i in range(3000)] + [("b", i, 7.0) for i in range(2500)] + [("c", i, None if i % 3 else float(i)) for i in range(2400)]
    got = {r.p: r.p95_value for r in metrics.latency_summary(spark.createDataFrame(rows, "p string, o int, v double"), ["p"], "v", "o").collect()}
    for p in ("a", None, "b", "c"):
        values = sorted((v for q, _, v in rows if q == p), key=lambda v: (v is not None, v))
        assert got[p] == values[int(0.95 * len(values))]


def test_walk_of_a_question(spark):
    """Two turns of a session: what the question names is near, the earlier turn's chunk joins by an edge, the gate keeps unlike ones out."""
    import pandas as pd

    from tessera.operators import question

    kw = lambda *ws: [{"type": "KEYWORD", "word": w} for w in ws]
    unit = lambda *at: [1.0 if i in at else 0.0 for i in range(64)]
    rows = [(1, True, 0.9, kw("alpha", "beta"), unit(1)), (2, True, 0.2, kw("gamma"), unit(2)), (3, False, None, kw("alpha", "beta", "delta"), unit(1, 3)), (4, False, None, kw("omega"), unit(4))]
    group = pd.DataFrame([(i, s, m, c, v, ["alpha", "unknownword"], unit(1)) for i, s, m, c, v in rows], columns=["doc_id", "seed", "similarity_score", "concepts", "embedding", "words", "q"])
    from dataclasses import replace

    found = {(i, g): (a, d) for i, g, a, _, d in question.walk(group, replace(Settings(), edge_top_p=1.0))}
    assert set(found) == {(i, g) for i in (1, 2, 3) for g in (True, False)} and found[3, True][0] and not found[1, True][0]
    assert found[1, True][1] < 0.3 and found[2, True][1] == pytest.approx(0.7 * 0.8 + 0.3)
    assert question.distances({"a": [("b", 1.0)], "b": [("a", 1.0), ("c", 3.5)]}, {"a"}, 4.0) == {"a": 0.0, "b": 1.0}
    assert sum(question.ranks({"a": [("b", 1.0)]}, {"a"}, 20, 0.85).values()) == pytest.approx(1.0)
    assert question.matched(["alpha", "alphas", "zzz"], {("KEYWORD", "alpha"), ("NER", "beta")}, 0.55) == {("KEYWORD", "alpha")}


def test_report_document(spark):
    made = sinks.docx_report("Title", {"Modes": spark.createDataFrame([("a", 1)], "mode string, n int")})
    assert files.docx_text(made) == "Title\nModes\nmode | n\na | 1"


def sql_rows(con, name):
    from tessera.plans.queries import ORACLES

    return sorted(tuple(r[c] for c in sorted(r)) for r in con.execute(ORACLES[name]).df().to_dict("records"))


@pytest.fixture(scope="module")
def with_copies(spark, tmp_path_factory):
    """A folder whose embeddings are mostly copies, ids of copies mixed with others, and the same as a view for SQL."""
    duckdb = pytest.importorskip("duckdb")
    folder = str(tmp_path_factory.mktemp("copies"))
    kinds = [[1.0, 0.0, 0.1], [0.9, 0.3, 0.0], [0.0, 1.0, 0.2], [0.2, 0.9, -0.4], [-1.0, 0.1, 0.3], [0.0, 0.0, 0.0]]
    rows = [(i, i % 2, kinds[i % 5 if i < 15 else 0 if i < 20 else 5]) for i in range(22)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    con.execute(f"COPY embeddings TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["similar_pairs", "vector_classes", "semantic_edges", "degree_topk", "neighbours", "graph_expansion", "graph_distance"])
def test_copies_of_vectors_have_their_links(spark, with_copies, name):
    from tessera.plans.queries import QUERIES

    folder, con = with_copies
    ours = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in QUERIES[name](spark, folder).collect())
    theirs = sql_rows(con, name)
    assert len(ours) == len(theirs) > 0 and all(a == pytest.approx(b) for a, b in zip(ours, theirs, strict=True))


def test_sessions_of_the_whole_table(spark, tmp_path):
    from datetime import datetime, timedelta

    from tessera.plans.queries import QUERIES

    start, minutes = datetime(2024, 1, 1), [(0, 0), (0, 20), (0, 45), (0, 100), (1, 10), (1, 3000), (1, 3029), (0, 3005), (0, 3080), (1, 5)]
    rows = [(i, str(start + timedelta(minutes=m)), u, "view", float(i), "{}") for i, (u, m) in enumerate(minutes)]
    # Two files, the later events first.
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for part in ("event_id >= 5 and event_id < 9", "event_id < 5 or event_id = 9"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    wanted = []
    for user in (0, 1):
        last = None
        for m, i in sorted((m, i) for i, (u, m) in enumerate(minutes) if u == user):
            if last is None or m > last + 30:
                wanted.append([user, m, m + 30, 0, 0.0])
            last, wanted[-1][2], wanted[-1][3], wanted[-1][4] = m, m + 30, wanted[-1][3] + 1, wanted[-1][4] + i
    found = QUERIES["stream_sessions"](spark, str(tmp_path)).selectExpr("user_id", "cast(session_start as string) a", "cast(session_end as string) b", "events", "value").collect()
    assert sorted(map(tuple, found)) == [(u, str(start + timedelta(minutes=a)), str(start + timedelta(minutes=b)), n, v) for u, a, b, n, v in wanted]


def test_answer_accuracy(spark):
    from tessera.operators import evaluate

    pairs = spark.createDataFrame([("the red fox", "the red fox"), ("one two", "three four"), (None, "a word"), ("", "")], "answer string, reference string")
    got = evaluate.answer_accuracy(pairs).first()
    assert (got.turns, got.accuracy, got.avg_exact) == (4, 0.25, 0.25)
    assert evaluate.answer_accuracy(pairs.limit(0)).first().accuracy is None
