"""The summary of runs and the comparison of modes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalogue as C


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(2)
    rows = []
    for run in ("base", "full", "other", "broken"):
        for t in range(9):
            bad = run == "broken" or (run == "other" and t in (0, 4))
            rows.append((run, 10 * t, "failed" if bad else None, f"e{t}" if bad else None, rng.random() * 100, rng.random(), t % 3, float(t % 2), t % 4, rng.random() if run != "base" else 0.0, rng.random() * 3, (rng.random(), 0.25)))
    return rows


KINDS = "run string, at int, status string, error string, latency_ms double, coverage_ratio double, evidence_count int, vllm_tokens_per_second double, gpu_sample_count int, evidence_mrr double, gpu_utilization_peak_pct double, retrieval struct<recall_at_5:double,hit_at_5:double>"


def test_turn_rows_and_summary(spark, raw):
    turns = C.turn_rows(spark.createDataFrame(raw, KINDS), ["run"], ["at"])
    assert len(turns.columns) == 1 + 1 + len(C.NUMBERS) + len(C.COUNTS) + len(C.TEXTS) + 1 + len(C.SHARES) and len(C.SHARES) == 27
    rows = {(r.run, r.iteration): r for r in turns.collect()}
    assert sorted(i for r, i in rows if r == "full") == list(range(1, 10))
    one = rows["full", 3]
    src = next(x for x in raw if x[0] == "full" and x[1] == 20)
    assert one.latency_ms == pytest.approx(round(src[4], 2)) and one.coverage_ratio == pytest.approx(round(src[5], 3)) and one.coverage_ratio_pct == pytest.approx(round(100 * one.coverage_ratio, 2))
    assert one.retrieval_recall_at_5 == pytest.approx(round(src[11][0], 4)) and one.vram_peak_gb == 0.0 and one.status == "ok" and one.error == ""
    summary = {r.run: r for r in C.summarize(turns, ["run"]).collect()}
    assert len(C.SUMMARY_SHARES) == 23 and set(f"{k}_pct" for k in C.SUMMARY_SHARES) <= set(summary["full"].asDict())
    for run, s in summary.items():
        own = [rows[run, i] for i in range(1, 10)]
        ok = [r for r in own if r.status == "ok"]
        assert (s.attempted_turns, s.total_turns, s.failed_turns) == (9, len(ok), 9 - len(ok))
        assert s.status == {"base": "completed", "full": "completed", "other": "partial_failed", "broken": "failed"}[run]
        assert s.first_error == {"other": "e0", "broken": "e0"}.get(run, "")
        if not ok:
            assert s.avg_latency_ms == 0.0 and s.final_coverage == 0.0 and s.coverage_progression == [] and s.latency_efficiency == 0.0
            continue
        mean = lambda f, some: round(sum(r[f] for r in some) / len(some), 4) if some else 0.0
        assert s.avg_evidence_mrr == pytest.approx(mean("evidence_mrr", [r for r in ok if r.evidence_count > 0]), abs=1e-4)
        assert s.avg_vllm_tokens_per_second == pytest.approx(mean("vllm_tokens_per_second", [r for r in ok if r.vllm_tokens_per_second > 0]))
        assert s.peak_gpu_utilization_pct == max((r.gpu_utilization_peak_pct for r in ok if r.gpu_sample_count > 0), default=0.0)
        assert s.avg_latency_excl_first_ms == pytest.approx(sum(r.latency_ms for r in ok[1:]) / len(ok[1:]), abs=0.006) and s.max_latency_ms == max(r.latency_ms for r in ok)
        assert s.final_coverage == ok[-1].coverage_ratio and s.coverage_progression == [r.coverage_ratio for r in ok]
        assert s.coverage_efficiency == pytest.approx(100 * s.final_coverage / 0.8, abs=0.06) and s.avg_retrieval_hit_at_5 == 0.25 and s.avg_retrieval_hit_at_5_pct == 25.0


def test_a_single_turn_is_its_own_mean(spark):
    turns = C.turn_rows(spark.createDataFrame([("r", 1, 7.0)], "run string, at int, latency_ms double"), ["run"], ["at"])
    s = C.summarize(turns, ["run"]).first()
    assert s.avg_latency_excl_first_ms == 7.0 and s.status == "completed" and s.latency_efficiency == pytest.approx(2857.1)


def test_comparison_marks_incomplete_modes(spark, raw):
    summaries = C.summarize(C.turn_rows(spark.createDataFrame(raw, KINDS), ["run"], ["at"]), ["run"])
    rows = C.compare_modes(summaries, "base", "full", "run")
    got = {(r["mode"], r.metric): r for r in rows.collect()}
    assert len(C.COMPARED) == 28 and len(got) == 3 * 28 and {m for m, _ in got} == {"full", "other", "broken"}
    assert {(m, r.state) for (m, _), r in got.items()} == {("full", "completed"), ("other", "incomplete"), ("broken", "incomplete")}
    assert all(r.base is None and r.delta is None for (m, _), r in got.items() if m != "full")
    told = {r.run: r for r in summaries.collect()}
    a, b = told["base"].avg_latency_ms, told["full"].avg_latency_ms
    r = got["full", "avg_latency_ms"]
    assert r.delta == pytest.approx(round(a - b, 4)) and r.improvement_pct == pytest.approx(100 * (a - b) / a, abs=0.006)
    r = got["full", "evidence_mrr"]
    assert r.base == 0.0 and r.delta == r.other > 0 and r.improvement_pct == 0.0
    assert got["full", "total_swap_operations"].delta is None and got["full", "total_swap_operations"].state == "completed"
    verdicts = {r["mode"]: r for r in C.mode_verdicts(rows).collect()}
    assert verdicts["other"].overall == "incomplete" and verdicts["full"].accuracy == "equal" and verdicts["full"].latency == ("improved" if b < a else "worse" if b > a else "equal") or told["full"].avg_latency_excl_first_ms != b
    ups = [verdicts["full"][k] for k in ("recall", "coverage", "accuracy", "latency")]
    assert verdicts["full"].overall == ("improved" if ups.count("improved") > ups.count("worse") else "worse" if ups.count("improved") < ups.count("worse") else "equal")
    none = C.compare_modes(summaries.where(F.col("run") != "base"), "base", "full", "run")
    assert none.count() == 0


def test_failed_turns_and_empty_tables(spark):
    asked = spark.createDataFrame([("r", 1, "why?", 12.5, "boom")], "run string, at int, query string, elapsed_ms double, error string")
    turn = C.turn_rows(C.failed_turns(asked), ["run"], ["at"]).first()
    assert (turn.status, turn.error, turn.query, turn.latency_ms, turn.latency_inference_ms, turn.active_chunks) == ("failed", "boom", "why?", 12.5, 12.5, 0)
    none = C.turn_rows(asked.limit(0), ["run"], ["at"])
    assert C.summarize(none, ["run"]).collect() == []


def test_the_largest_double_below_a_half_is_rounded_down(spark):
    rows = spark.createDataFrame([(0.49999999999999994,), (-0.49999999999999994,), (0.5,), (-0.5,), (2.5,), (-2.4,), (None,)], "x double")
    assert [r[0] for r in rows.select(C.digits(F.col("x"), 0)).collect()] == [0, 0, 1, -1, 3, -2, None]
    assert spark.createDataFrame([(0.15,)], "x double").select(C.digits(F.col("x") / 3, 1)).first()[0] == 0.0
