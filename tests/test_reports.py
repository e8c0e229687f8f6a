"""Row shapes of logs and reports, nested settings, and snapshots of counters."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings, load_settings
from tessera.operators import catalogue, metrics, scoring
from tessera.sources import sinks


def test_selection_records(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "q" * 200, 7, 0.5, 0.25), ("s", 1, "q" * 200, 8, 0.9, 0.75), ("t", 2, None, 9, 0.1, 0.1)], "session string, turn int, query string, doc_id long, semantic_score double, hybrid_score double")
    scores = scoring.score_rows(rows, ["session", "turn", "query"], "doc_id", "semantic_score")
    made = sinks.selection_records(scores, ["session", "turn"])
    assert made.columns == ["session", "turn", "query", "timestamp", "selected_chunks"]
    got = {(r.session, r.turn): r for r in made.collect()}
    assert len(got["s", 1].query) == 120 and [(c["rank"], c["doc_id"], c["cross_encoder_score"]) for c in got["s", 1].selected_chunks] == [(1, 7, -1.0), (2, 8, -1.0)] and got["t", 2].query is None
    for _ in range(2):
        sinks.append_jsonl(made, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert sinks.portable(rows.withColumn("embedding", F.array(F.lit(1.0)))).columns == rows.columns


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(m, i, 10.0 * i, i / 10, 3, float(i)) for m in ("baseline", "full") for i in range(1, 4)]
    return catalogue.turn_rows(spark.createDataFrame(rows, "mode string, at int, latency_ms double, coverage_ratio double, swap_operations int, vram_allocated_gb double"), ["mode"], ["at"]).cache()


def test_run_and_comparison_records(spark, turns):
    summaries = catalogue.summarize(turns, ["mode"])
    rows = {r["mode"]: json.loads(r.j) for r in sinks.run_records(summaries, turns, ["mode"]).select("mode", F.to_json(F.struct("summary", "detailed_metrics")).alias("j")).collect()}
    assert rows["full"]["summary"]["avg_latency_ms"] == 20.0 and [t["latency_ms"] for t in rows["full"]["detailed_metrics"]] == [10.0, 20.0, 30.0]
    told = sinks.comparison_records(catalogue.compare_modes(summaries, "baseline", "full")).first()
    assert told["mode"] == "full" and told.state == "completed" and told.metrics["avg_latency_ms"]["delta"] == 0.0 and len(told.metrics) == 28


def test_mode_table_and_series(spark, turns):
    table = sinks.mode_table(catalogue.summarize(turns, ["mode"]), labels={"full": "Full system"})
    assert len(table.columns) == 12 and {r.Mode for r in table.collect()} == {"baseline", "Full system"} and {r["Swaps"] for r in table.collect()} == {9.0}
    points = {(r["mode"], r.series, r.iteration): r.value for r in sinks.series(turns, ["mode"]).collect()}
    assert len(points) == 2 * 4 * 3 and points["full", "coverage", 3] == 0.3 and points["baseline", "latency", 2] == 20.0


def test_reports_say_what_they_leave_out(spark):
    rows = spark.range(12).select("id")
    assert "9 more rows are not shown" in sinks.html_report("t", {}, rows, most=3) and "more rows" not in sinks.html_report("t", {}, rows, most=12)
    import io
    import zipfile

    body = zipfile.ZipFile(io.BytesIO(sinks.docx_report("t", {"a": rows}, most=10))).read("word/document.xml").decode()
    assert "2 more rows are not shown" in body


def test_nested_settings(tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"rag": {"top_k": 9}, "graph": {"edge_top_p": 0.9, "use_entities": True}, "retrieval": {"rrf_k": 11, "bm25_weight": None}, "vllm": {"max_model_len": 4096}, "beta": 0.5, "rag2": {"top_k": 1}}))
    made = load_settings(str(tmp_path / "n.json"))
    assert (made.n_chunks, made.edge_top_p, made.rrf_k, made.bm25_weight, made.context_window, made.beta) == (9, 0.9, 11, Settings().bm25_weight, 4096, 0.5)
    for odd in ("[1]", '"x"', '{"rag": 3}'):
        (tmp_path / "o.json").write_text(odd)
        assert load_settings(str(tmp_path / "o.json")) == Settings()


def test_snapshot_and_performance(spark, turns):
    text = """# HELP x
vllm:prefix_cache_queries{model="a"} 30
vllm:prefix_cache_queries{model="b"} 10
vllm:prefix_cache_hits 10
vllm:time_to_first_token_seconds_sum 6
vllm:time_to_first_token_seconds_count{m="1"} 3
vllm:request_queue_time_seconds_sum 1
vllm:request_queue_time_seconds_count 0
vllm:gpu_cache_usage_perc 0.25
vllm:cache_config_info{block_size="16",dtype="auto"} 1
not a sample"""
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "line string")
    r = metrics.snapshot(metrics.parse_samples(lines).withColumn("node", F.lit("n")), ["node"]).first()
    assert (r.prefix_cache_queries_total, r.prefix_cache_hit_rate, r.ttft_avg_s, r.queue_time_avg_s, r.kv_cache_usage_perc, r.prompt_tokens_total, r.decode_time_avg_s) == (40.0, 0.25, 2.0, None, 0.25, None, None)
    assert r.cache_config == {"block_size": "16", "dtype": "auto"} and r.available
    p = {x["mode"]: x for x in metrics.performance_summary(turns, ["mode"]).collect()}["full"]
    assert (p.n, p.avg_value, p.max_value, p.p95_value, p.avg_without_first, p.avg_vram_allocated_gb, p.peak_vram_allocated_gb, p.swaps, p.swaps_per_turn) == (3, 20.0, 30.0, 30.0, 25.0, 2.0, 3.0, 9, 3.0)


def test_fallbacks_are_told(spark):
    """Question 1 has distances, 2 has none, 3 has no scores, 4 has no rows."""
    from tessera.config import modes

    rows = spark.createDataFrame([(1, 1, "a", "x", 0.9, 1.0), (1, 2, "a", "y", 0.5, 2.0), (2, 1, "a", "x", 0.9, None), (2, 2, "a", "y", None, None), (3, 5, "a", "x", None, 1.0)], "q long, doc_id long, query string, text string, semantic_score double, distance double")
    pool = spark.createDataFrame([(q, d, d) for q in (1, 2, 3, 4) for d in (1, 2, 3)], "q long, doc_id long, rank int")
    found = scoring.with_fallbacks(pool, rows, ["q"], Settings(), modes()["full"], 2).collect()
    got = {(r.q, r["rank"], r.doc_id, r.path, r.final_score is None) for r in found}
    assert got == {(1, 1, 1, "graph", False), (1, 2, 2, "graph", False), (2, 1, 1, "semantic", False), (2, 2, 2, "semantic", False), (3, 1, 1, "raw", True), (3, 2, 2, "raw", True), (4, 1, 1, "raw", True), (4, 2, 2, "raw", True)}
