"""The catalogue of what is measured in a turn, how turns are summed up for a mode, and which figures of modes are held against each other.

Schema, aggregates, percentages and comparison are generated from the tables below; a summary is one grouped pass over the turns of all runs at once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import half_away
from tessera.operators.metrics import exact_avg

#: The names of a turn's fields, by the digits that are kept.
DIGITS = {
    1: "ram_percent disk_used_gb disk_percent process_rss_mb",
    2: "latency_ms latency_search_ms latency_rerank_ms latency_swap_ms latency_inference_ms latency_observability_ms ram_used_gb gpu_utilization_avg_pct gpu_utilization_peak_pct gpu_memory_used_peak_mb gpu_memory_used_peak_pct gpu_power_avg_w gpu_power_peak_w",
    3: "coverage_ratio cache_hit_rate recall_at_k precision",
    4: "vram_allocated_gb vram_reserved_gb vram_peak_gb retrieval_recall_at_5 retrieval_precision_at_5 retrieval_f1_at_5 retrieval_hit_at_5 retrieval_mrr retrieval_ndcg_at_5 retrieval_map_at_5 "
    "evidence_recall_at_5 evidence_hit_at_5 evidence_mrr evidence_ndcg_at_5 evidence_map_at_5 evidence_token_f1_at_5 vllm_kv_cache_usage_before vllm_kv_cache_usage_after vllm_kv_cache_usage_delta "
    "vllm_prefix_cache_hit_rate_delta vllm_prefix_cache_queries_delta vllm_prefix_cache_hits_delta vllm_preemptions_delta vllm_request_success_delta vllm_generation_tokens_delta vllm_prompt_tokens_delta "
    "vllm_tokens_per_second vllm_total_tokens_per_second vllm_ttft_avg_s vllm_inter_token_latency_avg_s vllm_prefill_time_avg_s vllm_decode_time_avg_s vllm_queue_time_avg_s "
    "answer_semantic_similarity answer_token_f1 answer_exact_match answer_rouge1 answer_rouge2 answer_rougeL text_recall retrieval_semantic_similarity answer_correct",
}
COUNTS = "active_chunks total_chunks retrieval_relevant_count retrieval_retrieved_count evidence_count swap_operations graph_nodes graph_edges gpu_sample_count".split()
TEXTS = {"status": "ok", "error": "", "query": "", "response": ""}
NUMBERS = {f: n for n, names in DIGITS.items() for f in names.split()}
#: Shares, which are also told in per cent.
SHARES = [f for f in NUMBERS if f.startswith(("retrieval_", "evidence_", "answer_")) and f not in ("retrieval_semantic_similarity", "answer_correct")] + [
    "coverage_ratio", "cache_hit_rate", "recall_at_k", "precision", "vllm_kv_cache_usage_before", "vllm_kv_cache_usage_after", "vllm_kv_cache_usage_delta", "vllm_prefix_cache_hit_rate_delta",
]


class Rule(NamedTuple):
    """A figure of the summary: how the ok turns' field becomes it, over which of them, and its digits."""

    key: str
    how: str
    field: str
    only: str | None
    digits: int | None


def _means(fields: list[str], only: str | None = None, digits: int = 4) -> list[Rule]:
    return [Rule(f"avg_{f}", "avg", f, only, digits) for f in fields]


_QUALITY = [f for f in NUMBERS if f.startswith("retrieval_") and f != "retrieval_semantic_similarity"]
_EVIDENCE = [f for f in NUMBERS if f.startswith("evidence_")]
#: Conditions on turns that some means ask for.
ONLY = {"evidence": "evidence_count > 0", "gpu": "gpu_sample_count > 0", "tokens": "vllm_tokens_per_second > 0", "all_tokens": "vllm_total_tokens_per_second > 0", "later": "_place > 1 OR _ok = 1"}
SUMMARY = [
    Rule("avg_vram_gb", "avg", "vram_allocated_gb", None, 2), Rule("peak_vram_gb", "max", "vram_peak_gb", None, 2), Rule("min_vram_gb", "min", "vram_allocated_gb", None, 2),
    Rule("avg_latency_ms", "avg", "latency_ms", None, 2), Rule("avg_latency_excl_first_ms", "avg", "latency_ms", "later", 2), *_means(["latency_inference_ms", "latency_observability_ms"], None, 2),
    Rule("max_latency_ms", "max", "latency_ms", None, 2), Rule("min_latency_ms", "min", "latency_ms", None, 2), *_means(["active_chunks"], None, 2), Rule("final_coverage", "last", "coverage_ratio", None, None),
    *_means(_QUALITY), *_means(_EVIDENCE, "evidence"), *_means(["answer_semantic_similarity", "answer_token_f1", "answer_exact_match", "answer_rougeL"]),
    Rule("avg_cache_hit_rate", "avg", "cache_hit_rate", None, 2), Rule("final_cache_hit_rate", "last", "cache_hit_rate", None, None), Rule("total_swap_operations", "sum", "swap_operations", None, None),
    *_means(["vllm_kv_cache_usage_after"]), Rule("peak_vllm_kv_cache_usage_after", "max", "vllm_kv_cache_usage_after", None, 4), *_means(["vllm_kv_cache_usage_delta", "vllm_prefix_cache_hit_rate_delta"]),
    Rule("total_vllm_preemptions", "sum", "vllm_preemptions_delta", None, 4), *_means(["vllm_tokens_per_second"], "tokens"), *_means(["vllm_total_tokens_per_second"], "all_tokens"),
    Rule("avg_gpu_utilization_pct", "avg", "gpu_utilization_avg_pct", "gpu", 2), Rule("peak_gpu_utilization_pct", "max", "gpu_utilization_peak_pct", "gpu", 2), Rule("peak_gpu_memory_used_mb", "max", "gpu_memory_used_peak_mb", "gpu", 2),
    *_means(["graph_nodes", "graph_edges"], None, 1), Rule("peak_ram_used_gb", "max", "ram_used_gb", None, 2), *_means(["ram_percent"], None, 1), Rule("peak_process_rss_mb", "max", "process_rss_mb", None, 1), *_means(["disk_percent"], None, 1),
    *_means(["text_recall", "retrieval_semantic_similarity"]), Rule("multi_turn_accuracy", "avg", "answer_correct", None, 4),
]
#: Figures of the summary that are also told in per cent.
SUMMARY_SHARES = [r.key for r in SUMMARY if r.field in SHARES and r.key != "avg_vllm_kv_cache_usage_delta"]
#: What a mode should reach. Name, value, the figure, and whether more is better.
TARGETS = [("vram", 7.5, "peak_vram_gb", False), ("latency", 200.0, "max_latency_ms", False), ("coverage", 0.8, "final_coverage", True)]
#: (metric, figure, direction): 1 where more is better, -1 where less is, 0 where both are only told.
COMPARED = [
    *[(f.removeprefix("retrieval_"), f"avg_{f}", 1) for f in _QUALITY], *[(f, f"avg_{f}", 1) for f in _EVIDENCE], ("text_recall", "avg_text_recall", 1), ("semantic_similarity", "avg_retrieval_semantic_similarity", 1),
    ("answer_token_f1", "avg_answer_token_f1", 1), ("answer_rougeL", "avg_answer_rougeL", 1), ("coverage", "final_coverage", 1), ("multi_turn_accuracy", "multi_turn_accuracy", 1),
    *[(k, k, -1) for k in ("avg_latency_ms", "avg_latency_excl_first_ms", "avg_vram_gb", "avg_vllm_kv_cache_usage_after")], *[(k, k, 1) for k in ("avg_cache_hit_rate", "avg_vllm_tokens_per_second", "avg_gpu_utilization_pct")],
    *[(k, k, 0) for k in ("total_swap_operations", "total_vllm_preemptions")],
]


def digits(x: Column, n: int | None) -> Column:
    """n digits, half away from zero on the binary value."""
    scale = F.lit(float(10 ** (n or 0)))
    return x if n is None else half_away(x * scale) / scale


def per_cent(x: Column) -> Column:
    return digits(x * 100, 2)


def turn_rows(raw: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """All fields of the catalogue for every turn of raw: what is missing or null is 0 or empty, iteration counts the turns of a run, shares come with their per cent.

    raw has any of the fields, the columns of part and order, and may have retrieval, a struct whose fields become retrieval_ ones; other columns go.
    """
    if "retrieval" in raw.columns:
        inner = raw.schema["retrieval"].dataType.names
        raw = raw.withColumns({f"retrieval_{f}": F.col(f"retrieval.{f}") for f in inner if f"retrieval_{f}" not in raw.columns})
    have = set(raw.columns)
    number = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)
    made = {f: digits(number(f), n) for f, n in NUMBERS.items()} | {f: number(f).cast("long") for f in COUNTS}
    made |= {f: F.coalesce(F.col(f), F.lit(default)) if f in have else F.lit(default) for f, default in TEXTS.items()}
    made |= {"vllm_metrics_available": F.coalesce(F.col("vllm_metrics_available"), F.lit(False)) if "vllm_metrics_available" in have else F.lit(False)}
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    rows = raw.select(*part, place.alias("iteration"), *[c.alias(f) for f, c in made.items()])
    return rows.withColumns({f"{f}_pct": per_cent(F.col(f)) for f in SHARES})


def failed_turns(asked: DataFrame, elapsed: str = "elapsed_ms", error: str = "error") -> DataFrame:
    """Turns that failed, as raw rows: the time that was spent counts as inference, all else is missing. asked has query and what names the turn."""
    return asked.withColumns({"status": F.lit("failed"), "error": F.col(error), "latency_ms": F.col(elapsed), "latency_inference_ms": F.col(elapsed)}).drop(elapsed)


def summarize(turns: DataFrame, part: list[str]) -> DataFrame:
    """One row a run: state, counts and all figures over its ok turns, their per cent, targets, and the list of coverages in turn. Without ok turns the run has failed and its figures are 0."""
    ok = F.col("status") == "ok"
    seen = Window.partitionBy(*part)
    rows = turns.withColumns({"_place": F.sum(ok.cast("int")).over(seen.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)), "_ok": F.sum(ok.cast("int")).over(seen)})

    def figure(r: Rule) -> Column:
        x = F.when(ok & F.expr(ONLY[r.only]) if r.only else ok, F.col(r.field))
        found = {"avg": exact_avg, "max": F.max, "min": F.min, "sum": lambda c: F.sum(c.cast("decimal(24,6)")).cast("double"), "last": lambda c: F.max_by(c, F.when(ok, F.col("iteration")))}[r.how](x)
        return digits(F.coalesce(found.cast("double"), F.lit(0.0)), r.digits).alias(r.key)

    bad, good = F.count_if(F.col("status") == "failed"), F.count_if(ok)
    head = [
        F.when(good == 0, "failed").when(bad > 0, "partial_failed").otherwise("completed").alias("status"), F.count("*").alias("attempted_turns"), good.alias("total_turns"), bad.alias("failed_turns"),
        F.coalesce(F.min_by(F.when(F.col("status") == "failed", F.col("error")), F.when(F.col("status") == "failed", F.col("iteration"))), F.lit("")).alias("first_error"),
        F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("iteration", "coverage_ratio")))), lambda x: x["coverage_ratio"]).alias("coverage_progression"),
    ]
    found = rows.groupBy(*part).agg(*head, *[figure(r) for r in SUMMARY])
    found = found.withColumns({f"{k}_pct": per_cent(F.col(k)) for k in SUMMARY_SHARES})
    reached = {}
    for name, target, key, more in TARGETS:
        share = F.col(key) / target if more else target / F.col(key)
        reached |= {f"{name}_target": F.lit(target), f"{name}_achieved": F.col(key), f"{name}_efficiency": F.when(F.col(key) > 0, digits(share * 100, 1)).otherwise(F.lit(0.0))}
    return found.withColumns(reached)


def compare_modes(summaries: DataFrame, base: str, full: str, mode: str = "mode") -> DataFrame:
    """(mode, metric, state, base, other, delta, improvement_pct) of every mode but base, for all of COMPARED; delta is positive where the mode is better.

    state is completed if the base, `full` and the mode have turns and none failed, else incomplete, and then nothing is compared. A base of 0 gives the other value as delta and 0 per cent.
    """
    figures = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("way"), F.col(k).cast("double").alias("value")) for m, k, w in COMPARED])
    ready = (F.col("status") == "completed") & (F.col("total_turns") > 0)
    rows = summaries.select(F.col(mode).alias("mode"), ready.alias("ready"), F.explode(figures).alias("x")).select("mode", "ready", "x.*")
    against = rows.where(F.col("mode") == base).select("metric", F.col("value").alias("base"), F.col("ready").alias("_base"))
    both = summaries.where(F.col(mode).isin(base, full)).agg((F.count_if(ready) == 2).alias("_both"))
    joined = rows.where(F.col("mode") != base).join(F.broadcast(against), "metric").join(F.broadcast(both), F.lit(True))
    fine = F.col("_both") & F.col("ready") & F.col("_base")
    up = F.when(F.col("base") == 0, F.col("value")).otherwise(digits(F.col("value") - F.col("base"), 4)) * F.col("way")
    share = F.when(F.col("base") == 0, F.lit(0.0)).otherwise(digits((F.col("value") - F.col("base")) * F.col("way") / F.abs("base") * 100, 2))
    told = fine & (F.col("way") != 0)
    return joined.select(
        "mode", "metric", F.when(fine, "completed").otherwise("incomplete").alias("state"), F.when(fine, F.col("base")).alias("base"), F.when(fine, F.col("value")).alias("other"),
        F.when(told, up).alias("delta"), F.when(told, share).alias("improvement_pct"),
    )


def mode_verdicts(compared: DataFrame) -> DataFrame:
    """(mode, recall, coverage, accuracy, latency, overall): improved, worse or equal against the base, and the majority; incomplete modes have the word incomplete throughout.

    Recall is that of texts, or of rank 5 where no mode finds a text; latency is without the first turn.
    """
    names = {"coverage": "coverage", "multi_turn_accuracy": "accuracy", "avg_latency_excl_first_ms": "latency"}
    word = F.when(F.col("state") != "completed", "incomplete").when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "worse").otherwise("equal")
    of = lambda metric: F.max(F.when(F.col("metric") == metric, F.col("word")))
    told = F.max(F.when((F.col("metric") == "text_recall") & ((F.col("base") != 0) | (F.col("other") != 0)), F.col("word")))
    found = compared.withColumn("word", word).groupBy("mode").agg(F.coalesce(told, of("recall_at_5")).alias("recall"), *[of(m).alias(n) for m, n in names.items()])
    each = F.array("recall", "coverage", "accuracy", "latency")
    count = lambda w: F.size(F.filter(each, lambda x: x == w))
    return found.withColumn("overall", F.when(count("incomplete") > 0, "incomplete").when(count("improved") > count("worse"), "improved").when(count("improved") < count("worse"), "worse").otherwise("equal"))
