"""Turns of sessions in which what earlier turns used is left out of later searches.

All sessions go at once, one round for each place in a session: the questions of the round meet the ledger of what their sessions have used so far, each gets its
pool, the pool is reranked, and what is chosen is added to the ledger. The ledger is a table with a folder a round in the shared folder; only rows of sessions
that still have turns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import shared_dir, store
from tessera.operators import fusion, state

Choose = Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]


class Ledger:
    """A table that grows by one folder a round."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}", None

    def add(self, rows: DataFrame, round_: int) -> DataFrame:
        """Write the rows of a round, and read them back."""
        rows.write.parquet(f"{self.path}/round={round_}")
        self.schema = rows.schema
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={round_}")

    def rows(self) -> DataFrame | None:
        """All rounds so far, with the column round."""
        return None if self.schema is None else self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)


def ranked_lists(vector: DataFrame, lexical: DataFrame, lexical_weight: float, k: int, part: str, id_col: str, top: int) -> DataFrame:
    """(part, id, narrow, wide): places in the fusion of both lists cut at top, and in that of the lists cut at twice as many, null where a row is in neither list."""
    fused = lambda n: fusion.hybrid(vector.where(F.col("rank") <= n), lexical.where(F.col("rank") <= n), lexical_weight, k, [part], id_col, 2 * n).select(part, id_col, "rank")
    wide = fused(2 * top).withColumnRenamed("rank", "wide")
    return wide.join(fused(top).withColumnRenamed("rank", "narrow"), [part, id_col], "left")


def pool(asked: DataFrame, lists: DataFrame, used: DataFrame | None, n: int, top: int, part: str, id_col: str) -> DataFrame:
    """Candidates of the questions asked(session, part), with place and is_used: what the session has not used by rank, then, as far as these are fewer than n, used ones.

    A session that has used nothing takes the narrow list, others the wide one; top candidates at most.
    """
    rows = asked.join(lists, part)
    if used is None:
        rows = rows.withColumns({"is_used": F.lit(False), "_any": F.lit(False)})
    else:
        gone = used.select("session", id_col).join(asked.select("session").distinct(), "session", "left_semi").distinct().withColumn("is_used", F.lit(True))
        rows = rows.join(gone, ["session", id_col], "left").join(gone.select("session", F.lit(True).alias("_any")).distinct(), "session", "left")
        rows = rows.withColumns({"is_used": F.coalesce("is_used", F.lit(False)), "_any": F.coalesce("_any", F.lit(False))})
    rows = rows.withColumn("_rank", F.when(F.col("_any"), F.col("wide")).otherwise(F.col("narrow"))).where("_rank IS NOT NULL")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy("is_used", "_rank")))
    return placed.where((F.col("place") <= top) & (~F.col("is_used") | (F.col("place") <= n))).drop("_any", "_rank", "narrow", "wide")


def turn_loop(turns: DataFrame, lists: DataFrame, choose: Choose, n: int, top: int, part: str = "item_id", id_col: str = "doc_id", exclude: bool = True) -> DataFrame:
    """(session, turn, part, id, rank, is_new, and what choose adds): what each turn shows.

    turns(session, turn, part) has a row a question; turns of a session are taken in the order of turn, equal ones in that of part. lists(part, id, narrow, wide, ...) has the
    candidates of every question, as of ranked_lists(), with all that choose needs. choose(pool, pools, used) gives the rows of pool that are shown, with rank; pools has the pools of all rounds so far, with
    round, and used what was shown before this round, None in the first. is_new is false for what an earlier turn of the session has shown. Without exclude every turn searches everything. Null sessions take no part; an empty table gives no rows.
    """
    spark = turns.sparkSession
    order = Window.partitionBy("session").orderBy("turn", part)
    numbered = store(turns.where("session IS NOT NULL").withColumn("_round", F.row_number().over(order)), "turn-rounds")
    last = numbered.agg(F.max("_round")).first()[0] or 0
    shown, pools = Ledger(spark, "turn-shown"), Ledger(spark, "turn-pools")
    for r in range(1, last + 1):
        asked = numbered.where(F.col("_round") == r).drop("_round")
        before = shown.rows()
        here = pools.add(pool(asked, lists, before if exclude else None, n, top, part, id_col), r)
        picked = choose(here, pools.rows(), before)
        if before is None:
            picked = picked.withColumn("is_new", F.lit(True))
        else:
            seen = before.select("session", id_col).join(asked.select("session").distinct(), "session", "left_semi").distinct().withColumn("_seen", F.lit(True))
            picked = picked.join(seen, ["session", id_col], "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")
        shown.add(picked, r)
    found = shown.rows()
    if found is None:
        kinds = {**dict(turns.dtypes), **dict(lists.dtypes)}
        return spark.createDataFrame([], f"session {kinds['session']}, turn {kinds['turn']}, {part} {kinds[part]}, {id_col} {kinds[id_col]}, rank int, is_new boolean")
    return found.drop("round")


def turn_statistics(shown: DataFrame, pool_rows: DataFrame, id_col: str = "doc_id", size: str = "chunk_size") -> DataFrame:
    """Of each turn: chunks shown, new ones, uses of its session before it, different chunks so far, the pool's size, coverage in per cent, and the size of the context.

    pool_rows(session, id) has what a session can be shown.
    """
    own = shown.groupBy("session", "turn").agg(F.count("*").alias("context_chunks_used"), F.count_if("is_new").alias("new_chunks"), F.sum(size).alias("context_tokens"))
    past = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("excluded_before", F.coalesce(F.sum("context_chunks_used").over(past), F.lit(0)))
    curve = state.coverage_curve(shown, pool_rows, "session", "turn", id_col).drop("new_chunks")
    return own.join(curve, ["session", "turn"])
