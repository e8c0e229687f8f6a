"""Rank fusion, hybrid candidates, and filling up with used ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int, part: list[str], id_col: str, top: int | None = None) -> DataFrame:
    """(part, id, rrf_score, rank): sum of weight / (k + rank) over ranked lists(part, id, rank); ties to the better first rank, then the smaller id."""
    tagged = [df.select(*part, id_col, F.col("rank").alias("_r"), F.lit(i).alias("_list"), (F.lit(float(w)) / (k + F.col("rank"))).alias("_s")) for i, (df, w) in enumerate(lists)]
    fused = reduce(DataFrame.unionByName, tagged).groupBy(*part, id_col).agg(F.sum("_s").alias("rrf_score"), F.min(F.struct("_list", "_r")).alias("_first"))
    order = Window.partitionBy(*part).orderBy(F.round("rrf_score", 8).desc(), F.col("_first._list"), F.col("_first._r"), id_col)
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("_first")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def pool_size(n: int, excluded: bool, multiplier: int = 3, minimum: int = 20) -> int:
    return max(minimum, multiplier * n) * (2 if excluded else 1)


def hybrid(vector: DataFrame, lexical: DataFrame, lexical_weight: float, k: int, part: list[str], id_col: str, top: int) -> DataFrame:
    """Fused candidates; a query without lexical hits, and a lexical weight of 0, keep the vector order."""
    if lexical_weight == 0:
        return vector.where(F.col("rank") <= top).select(*part, id_col, (F.lit(1.0) / (k + F.col("rank"))).alias("rrf_score"), "rank")
    return reciprocal_rank_fusion([(vector, 1.0 - lexical_weight), (lexical, lexical_weight)], k, part, id_col, top)


def backfill(ranked: DataFrame, used: DataFrame, n: int, part: list[str], id_col: str) -> DataFrame:
    """The first n of each query: rows that are not used by rank, then used ones."""
    marked = ranked.join(used.select(*part, id_col, F.lit(True).alias("is_used")).distinct(), [*part, id_col], "left").withColumn("is_used", F.coalesce("is_used", F.lit(False)))
    order = Window.partitionBy(*part).orderBy("is_used", "rank")
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
