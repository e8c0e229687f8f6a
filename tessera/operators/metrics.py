"""Summaries of logs and gauges: latencies, counters, sample lines, monitored events, cache figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})?[ ]+([-+0-9.eE]+)$"


def exact_avg(value: str | Column) -> Column:
    """A mean over decimals of six digits: it does not depend on the order in which rows are added."""
    c = F.col(value) if isinstance(value, str) else value
    return F.avg(c.cast("decimal(24,6)")).cast("double")


def p95(values: Column) -> Column:
    """The element at int(0.95 n) of the sorted values: one past the nearest rank where 0.95 n is whole."""
    return F.get(F.sort_array(F.collect_list(values)), F.floor(F.lit(0.95) * F.count(values)).cast("int"))


def latency_summary(rows: DataFrame, part: list[str], value: str, order: str) -> DataFrame:
    """Counts, mean, largest, smallest, p95, and the mean without the first row of a part that has several.

    p95 is exact: approximate quantiles, whose error in rank is bounded, bracket its place; rows below the bracket are counted and only those inside, a hundredth, are ranked.
    """
    measured = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
    head = rows.groupBy(*part).agg(
        F.count("*").alias("n"), exact_avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.min(order).alias("_first"),
        F.percentile_approx(measured, [0.944, 0.956], 10000).alias("_q"),
    ).withColumn("_k", F.floor(0.95 * F.col("n")))
    # A part of few rows is its own bracket.
    wide = F.col("n") < 2000
    head = head.withColumns({"_low": F.when(~wide, F.get("_q", F.lit(0))), "_high": F.when(~wide, F.get("_q", F.lit(1)))})
    placed = _null_safe(rows.select(*part, F.col(value).alias("_v"), F.col(order).alias("_o")), head.select(*part, "_first", "_low", "_high", "_k"), part)
    later = placed.groupBy(*part).agg(exact_avg(F.when(F.col("_o") > F.col("_first"), F.col("_v"))).alias("_later"), F.count_if(F.col("_v").isNull() | (F.col("_v") < F.col("_low"))).alias("_below"))
    # Nulls sort first, below every value; without a bracket they are ranked with the rest.
    inside = placed.where(F.col("_low").isNull() | F.col("_v").between(F.col("_low"), F.col("_high")))
    inside = inside.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy("_v")) - 1)
    top = _null_safe(inside, later, part).where(F.col("_at") + F.when(F.col("_low").isNull(), 0).otherwise(F.col("_below")) == F.col("_k")).select(*part, F.col("_v").alias("p95_value"))
    out = _null_safe(_null_safe(head.drop("_q", "_low", "_high", "_k", "_first"), later, part), top, part, "left")
    return out.select(*part, "n", "avg_value", "max_value", "min_value", "p95_value", F.coalesce("_later", "avg_value").alias("avg_without_first"))


def _null_safe(a: DataFrame, b: DataFrame, part: list[str], how: str = "inner") -> DataFrame:
    """A join on the columns of part, nulls being equal; each column comes once."""
    renamed = b
    same = F.lit(True)
    for i, c in enumerate(part):
        renamed = renamed.withColumnRenamed(c, f"_r{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return a.join(renamed, same, how).drop(*[f"_r{i}" for i in range(len(part))])


def moving_average(rows: DataFrame, part: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)
    return rows.withColumn("moving_avg", F.avg(F.col(value).cast("decimal(24,6)")).over(frame).cast("double"))


def counter_delta(rows: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Increase since the row before, 0 for a reset, a null or the first row."""
    before = F.lag(value).over(Window.partitionBy(*part).orderBy(*order))
    return rows.withColumn("delta", F.greatest(F.lit(0.0), F.coalesce(F.col(value) - before, F.lit(0.0))))


def parse_samples(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, labels, value) of metric lines; comments and lines that do not parse are left out; the prefix vllm: or vllm_ goes."""
    kept = lines.where(F.col(line).rlike(SAMPLE))
    part = lambda i: F.regexp_extract(line, SAMPLE, i)
    pattern = r"([A-Za-z_][A-Za-z0-9_]*)=\"([^\"]*)\""
    keys, values = (F.regexp_extract_all(part(2), F.lit(pattern), F.lit(i)) for i in (1, 2))
    return kept.select(F.regexp_replace(part(1), "^vllm[:_]", "").alias("name"), F.map_from_arrays(keys, values).alias("labels"), part(3).try_cast("double").alias("value")).where("value is not null")


def sample_sums(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.sum("value").alias("value"))


#: The counters behind each mean time of a snapshot.
TIMES = {"e2e_latency": "e2e_request_latency", "ttft": "time_to_first_token", "inter_token_latency": "inter_token_latency", "prefill_time": "request_prefill_time", "decode_time": "request_decode_time", "queue_time": "request_queue_time"}
COUNTERS = {"prefix_cache_queries_total": "prefix_cache_queries", "prefix_cache_hits_total": "prefix_cache_hits", **{n: n for n in ("gpu_cache_usage_perc", "prompt_tokens_total", "generation_tokens_total", "num_requests_running", "num_requests_waiting", "num_requests_swapped", "num_preemptions_total", "request_success_total")}}


def snapshot(samples: DataFrame, part: list[str]) -> DataFrame:
    """One row a part of samples(part, name, labels, value): counters summed over labels, mean times from sums and counts, the hit ratio of the prefix cache, and the labels of the cache's settings.

    What was not sampled is null, a mean over a count of 0 too.
    """
    of = lambda name: F.sum(F.when(F.col("name") == name, F.col("value")))
    over = lambda a, b: F.when(b != 0, a / b)
    config = F.max_by("labels", F.when(F.col("name") == "cache_config_info", F.col("value")))
    return samples.groupBy(*part).agg(
        F.lit(True).alias("available"), F.coalesce(of("kv_cache_usage_perc"), of("gpu_cache_usage_perc")).alias("kv_cache_usage_perc"), *[of(n).alias(c) for c, n in COUNTERS.items()],
        over(of("prefix_cache_hits"), of("prefix_cache_queries")).alias("prefix_cache_hit_rate"), *[over(of(f"{n}_seconds_sum"), of(f"{n}_seconds_count")).alias(f"{c}_avg_s") for c, n in TIMES.items()], config.alias("cache_config"),
    )


def performance_summary(turns: DataFrame, part: list[str], order: str = "iteration") -> DataFrame:
    """latency_summary() of latency_ms with mean and peak memory, mean and last hit rate, and swaps in all and a turn."""
    own = latency_summary(turns, part, "latency_ms", order)
    more = turns.groupBy(*part).agg(
        *[x for c in ("vram_allocated_gb", "vram_reserved_gb") for x in (exact_avg(c).alias(f"avg_{c}"), F.max(c).alias(f"peak_{c}"))], exact_avg("cache_hit_rate").alias("avg_hit_rate"), F.max_by("cache_hit_rate", order).alias("final_hit_rate"),
        F.sum("swap_operations").alias("swaps"), (F.sum("swap_operations") / F.count("*")).alias("swaps_per_turn"),
    )
    return _null_safe(own, more, part)


def pair_events(events: DataFrame, key: list[str], order: str = "ts") -> DataFrame:
    """Each end event with the first start of its key; an end without start stays as end_no_start."""
    starts = events.where("event = 'start'").groupBy(*key).agg(F.min(F.struct(order, "value")).alias("_start"))
    ends = events.where("event = 'end'")
    joined = ends.join(starts, key, "left")
    return joined.select(*key, F.when(F.col("_start").isNull(), "end_no_start").otherwise("end").alias("event"), F.col(order), F.col("value").alias("end_value"), F.col("_start.value").alias("start_value"), (F.col("value") - F.coalesce("_start.value", "value")).alias("delta"))


def mode_summary(turns: DataFrame, part: list[str], measures: list[str]) -> DataFrame:
    """Turns, ok and failed ones, the status, the first error, and means of measures over ok turns."""
    ok = F.col("status") == "ok"
    n_ok, n_bad = F.count_if(ok), F.count_if(~ok)
    status = F.when(n_bad == 0, "completed").when(n_ok > 0, "partial_failed").otherwise("failed")
    return turns.groupBy(*part).agg(
        F.count("*").alias("turns"), n_ok.alias("ok_turns"), n_bad.alias("failed_turns"), status.alias("status"), F.min_by(F.when(~ok, F.col("error")), F.when(~ok, F.col("iteration"))).alias("first_error"),
        *[F.coalesce(exact_avg(F.when(ok, F.col(m))), F.lit(0.0)).alias(f"avg_{m}") for m in measures],
    )


def history_summary(steps: DataFrame, part: list[str], order: str, measures: list[str], last: str) -> DataFrame:
    """Steps and means of measures of each part, and `last` at the largest order; nulls count as steps but not in means."""
    return steps.groupBy(*part).agg(F.count("*").alias("steps"), *[exact_avg(m).alias(f"avg_{m}") for m in measures], F.max_by(last, order).alias(f"final_{last}"))


def percents(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.round(100 * F.col(c), 2).alias(f"{c}_pct") for c in columns])


def target_efficiency(target: float, achieved: Column, coverage: bool = False) -> Column:
    """100 x target / achieved, for coverage achieved / target; 0 where nothing was measured."""
    return F.when(achieved > 0, F.round(100 * (achieved / target if coverage else target / achieved), 2)).otherwise(F.lit(0.0))


def progress(done: Column, total: Column) -> Column:
    """Per cent from 0 to 100 with one digit."""
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * done / total)), 1)).otherwise(F.lit(0.0))


def gauges(samples: DataFrame, part: list[str], measures: list[str]) -> DataFrame:
    """Mean and peak of each gauge; missing samples do not count."""
    return samples.groupBy(*part).agg(*[x for m in measures for x in (exact_avg(m).alias(f"avg_{m}"), F.max(m).alias(f"peak_{m}"), F.count(m).alias(f"n_{m}"))])


def monitor_summary(events: DataFrame, part: list[str]) -> DataFrame:
    """Mean, largest and smallest value of end events, 0 without any, and the number of start events."""
    end = F.when(F.col("event") == "end", F.col("value"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return events.groupBy(*part).agg(zero(exact_avg(end)).alias("avg_value"), zero(F.max(end)).alias("max_value"), zero(F.min(end)).alias("min_value"), F.count_if(F.col("event") == "start").alias("starts"))
