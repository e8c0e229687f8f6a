"""Hybrid scores and the rerank chain: weights, fallbacks, boost, anchor, soft filter, blending, adaptive cut, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import ModeSpec, Settings
from tessera.functions import text as X
from tessera.functions.numbers import half_away


def _over(part: list[str]) -> Window:
    return Window.partitionBy(*part)


def hybrid_score(rows: DataFrame, part: list[str], settings: Settings, mode: ModeSpec, query: str = "query", text: str = "text") -> DataFrame:
    """rows(part, query, text, semantic_score, distance) with query_type, alpha, beta, graph_score, hybrid_score.

    Order of steps: weights by class of query; semantic only if no row of the query has a distance or the best semantic
    score is low; weighted sum; keyword boost, at most 1; anchor for high semantic scores. A missing distance counts as 100.
    Columns query_class and keyword_hits, if there, stand for what would be found from the texts.
    """
    kind = (F.col("query_class") if "query_class" in rows.columns else X.query_class(F.col(query))) if mode.dynamic_weights else F.lit("default")
    by_kind = lambda i, rest: F.when(F.col("query_type") == "factual", settings.factual_weights[i]).when(F.col("query_type") == "complex", settings.complex_weights[i]).otherwise(rest)
    out = rows.withColumn("query_type", kind).withColumn("graph_score", 1.0 / (1.0 + F.coalesce("distance", F.lit(100.0))))
    alone = (F.max("distance").over(_over(part)).isNull()) | (F.max("semantic_score").over(_over(part)) < settings.low_semantic)
    out = out.withColumn("_alone", alone)
    out = out.withColumns({"alpha": F.when(F.col("_alone"), 1.0).otherwise(by_kind(0, settings.alpha)), "beta": F.when(F.col("_alone"), 0.0).otherwise(by_kind(1, settings.beta))})
    score: Column = F.col("alpha") * F.col("semantic_score") + F.col("beta") * F.col("graph_score")
    if mode.boost:
        hits = F.col("keyword_hits") if "keyword_hits" in rows.columns else X.keyword_hits(X.keyword_words(F.col(query)), F.col(text))
        score = F.when(hits >= settings.boost_least_hits, F.least(F.lit(1.0), score + F.least(F.lit(settings.boost_cap), settings.boost_step * hits))).otherwise(score)
    if mode.anchor:
        score = F.when(F.col("semantic_score") >= settings.anchor_threshold, F.greatest(score, F.lit(settings.anchor_floor))).otherwise(score)
    return out.withColumn("hybrid_score", F.round(score, 6)).drop("_alone")


def ranked(rows: DataFrame, part: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(_over(part).orderBy(*order)))


def soft_filter(rows: DataFrame, part: list[str], least: float, score: str = "hybrid_score", id_col: str = "doc_id") -> DataFrame:
    """Rows with low semantic scores go behind all others; none is dropped."""
    return ranked(rows, part, [F.col("semantic_score") < least, F.col(score).desc(), F.col(id_col)])


def low_semantic_warning(rows: DataFrame, part: list[str], least: float) -> DataFrame:
    """Rank 1 of each query with a flag for a low semantic score."""
    return rows.where("rank = 1").withColumn("low_semantic", F.col("semantic_score") < least)


def blend_reranked(rows: DataFrame, part: list[str], ce: str, n: int, weight: float, id_col: str = "doc_id") -> DataFrame:
    """The first n rows by rank get (1 - weight) x hybrid + weight x scaled reranker score and a new order; the rest follows as it was.

    Scores are scaled to 0..1 within the first n rows of a query; equal ones all become 1.
    """
    head = F.col("rank") <= n
    low, high = (f(F.when(head, F.col(ce))).over(_over(part)) for f in (F.min, F.max))
    scaled = F.when(high > low, (F.col(ce) - low) / (high - low)).otherwise(F.lit(1.0))
    out = rows.withColumn("cross_encoder_score", F.when(head, scaled).otherwise(F.lit(-1.0)))
    out = out.withColumn("final_score", F.round(F.when(head, (1 - weight) * F.col("hybrid_score") + weight * F.col("cross_encoder_score")).otherwise(F.col("hybrid_score")), 6)).withColumnRenamed("rank", "_before")
    return ranked(out, part, [(F.col("_before") > n), F.when(F.col("_before") <= n, -F.col("final_score")), F.col("_before"), F.col(id_col)]).drop("_before")


def adaptive_cut(rows: DataFrame, part: list[str], top_k: int, settings: Settings, score: str = "final_score") -> DataFrame:
    """Rows kept by walking down the ranks: stop at a score under a share of the first, or at a large gap once enough are kept.

    Lists of at most adaptive_keep rows and lists whose first score is not positive stay as they are.
    """
    by_rank = _over(part).orderBy("rank")
    n, first = F.count("*").over(_over(part)), F.first(score).over(by_rank)
    keep = settings.adaptive_keep
    marked = rows.withColumns({"_n": n, "_top": first})
    marked = marked.where((F.col("_n") <= keep) | (F.col("_top") <= 0) | (F.col("rank") <= top_k))
    gap = F.lag(score).over(by_rank) - F.col(score)
    stop = (F.col("_n") > keep) & (F.col("_top") > 0) & (F.col("rank") > 1) & ((F.col(score) < settings.adaptive_ratio * F.col("_top")) | ((gap > settings.adaptive_gap * F.col("_top")) & (F.col("rank") - 1 >= keep)))
    marked = marked.withColumn("_stop", stop.cast("int"))
    run = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("_past", F.max("_stop").over(run)).where((F.col("_past") == 0) | ((F.col("rank") <= keep) & (F.col("_n") > keep))).drop("_n", "_top", "_stop", "_past")


def pad(chosen: DataFrame, rows: DataFrame, part: list[str], id_col: str, least: int) -> DataFrame:
    """chosen, and the best rows that are not in it until each query has `least` rows; padded is true for those."""
    have = chosen.groupBy(*part).agg(F.count("*").alias("_have"))
    rest = rows.join(chosen.select(*part, id_col), [*part, id_col], "left_anti").join(have, part, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    rest = ranked(rest, part, [F.col("rank"), F.col(id_col)], "_more").where(F.col("_have") + F.col("_more") <= least)
    extra = rest.withColumn("rank", (F.col("_have") + F.col("_more")).cast("int")).withColumn("padded", F.lit(True)).drop("_have", "_more")
    return ranked(chosen, part, [F.col("rank")]).withColumn("padded", F.lit(False)).unionByName(extra)


def baseline_filter(rows: DataFrame, part: list[str], least: float, similarity: str = "similarity_score") -> DataFrame:
    """Rows similar enough, a missing similarity counting as 1; if none of a query is, its first row."""
    ok = F.coalesce(similarity, F.lit(1.0)) >= least
    return rows.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(_over(part))).where(F.col("_ok") | (~F.col("_any") & (F.col("rank") == 1))).drop("_ok", "_any")


def prompt_budget(rows: DataFrame, part: list[str], budget: int, text: str = "text") -> DataFrame:
    """The longest prefix by rank whose estimated tokens fit the budget, with the running sum."""
    run = _over(part).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("tokens", X.token_estimate(F.col(text))).withColumn("used_tokens", F.sum("tokens").over(run)).where(F.col("used_tokens") <= budget)


def score_statistics(rows: DataFrame, part: list[str]) -> DataFrame:
    """Count, mean, population deviation, minimum and maximum of hybrid scores, means of the parts, and of valid reranker scores."""
    valid = F.when(F.col("cross_encoder_score") >= 0, F.col("cross_encoder_score"))
    return rows.groupBy(*part).agg(
        F.count("*").alias("n"), F.avg("hybrid_score").alias("mean_hybrid"), F.stddev_pop("hybrid_score").alias("std_hybrid"), F.min("hybrid_score").alias("min_hybrid"),
        F.max("hybrid_score").alias("max_hybrid"), F.avg("semantic_score").alias("mean_semantic"), F.avg("graph_score").alias("mean_graph"), F.avg(valid).alias("mean_cross_encoder"),
    )


def rerank(rows: DataFrame, part: list[str], settings: Settings, mode: ModeSpec, top_k: int, query: str = "query", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The whole chain on candidates(part, query, text, semantic_score, distance). Needs no reranker model: token F1 stands for it, or the column reranker_score if there."""
    scored = hybrid_score(rows, part, settings, mode, query, text)
    order = soft_filter(scored, part, settings.min_similarity, id_col=id_col) if mode.soft_filter else ranked(scored, part, [F.col("hybrid_score").desc(), F.col(id_col)])
    if mode.rerank:
        ce = F.col("reranker_score") if "reranker_score" in rows.columns else F.round(X.token_f1(F.col(query), F.col(text)), 6)
        order = blend_reranked(order.withColumn("_ce", ce), part, "_ce", settings.rerank_n, settings.rerank_weight, id_col).drop("_ce")
    else:
        order = order.withColumns({"cross_encoder_score": F.lit(-1.0), "final_score": F.col("hybrid_score")})
    chosen = adaptive_cut(order, part, top_k, settings) if mode.adaptive else order
    chosen = chosen.where(F.col("rank") <= top_k)
    return pad(chosen, order, part, id_col, settings.min_return)


def with_fallbacks(pool: DataFrame, rows: DataFrame, part: list[str], settings: Settings, mode: ModeSpec, top_k: int, rank: str = "rank", id_col: str = "doc_id") -> DataFrame:
    """(part, id, rank, final_score, path): rerank() of rows, and what is shown of the questions for which that gives nothing.

    path is graph where distances had weight, semantic where they had none, and raw where no row of a question has a semantic score: these keep the first top_k of pool(part, id, rank) without scores.
    """
    good = rows.withColumn("_any", F.max("semantic_score").over(_over(part))).where(F.col("_any").isNotNull()).drop("_any").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    done = rerank(good, part, settings, mode, top_k, id_col=id_col)
    done = done.select(*part, id_col, "rank", "final_score", F.when(F.max("beta").over(_over(part)) > 0, "graph").otherwise("semantic").alias("path"))
    left = pool.where(F.col(rank) <= top_k).join(good.select(*part).distinct(), part, "left_anti")
    return done.unionByName(left.select(*part, id_col, F.col(rank).alias("rank"), F.lit(None).cast("double").alias("final_score"), F.lit("raw").alias("path")))


def score_rows(rows: DataFrame, part: list[str], id_col: str, order: str) -> DataFrame:
    """(part, id, rank from 1, five scores to four digits) in the given order, ties by id; what is missing is 0, a missing cross-encoder score -1, a missing final score the hybrid one."""
    score = lambda c, default: F.coalesce(F.col(c).cast("double"), default) if c in rows.columns else default
    zero, hybrid = F.lit(0.0), score("hybrid_score", F.lit(0.0))
    values = {"semantic_score": score("semantic_score", zero), "graph_score": score("graph_score", zero), "hybrid_score": hybrid, "cross_encoder_score": score("cross_encoder_score", F.lit(-1.0)), "final_score": score("final_score", hybrid)}
    place = F.row_number().over(Window.partitionBy(*part).orderBy(order, id_col))
    # On the binary value: round() would take its shortest decimal form, and raise a half that is none.
    digits = lambda v: half_away(v * 10000) / F.lit(10000.0)
    return rows.select(*part, id_col, place.alias("rank"), *[digits(v).alias(c) for c, v in values.items()])
