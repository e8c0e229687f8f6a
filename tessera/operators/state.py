"""Per-session state: used chunks and coverage, document lists, and the hot and cold cache of chunk vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unused(pool: DataFrame, usage: DataFrame, part: list[str], id_col: str) -> DataFrame:
    return pool.join(usage.select(*part, id_col), [*part, id_col], "left_anti")


def coverage_curve(usage: DataFrame, pool: DataFrame, session: str, iteration: str, id_col: str) -> DataFrame:
    """(session, iteration, new_chunks, used_chunks, total_chunks, coverage_pct): a chunk counts from the first iteration that used it."""
    first = usage.groupBy(session, id_col).agg(F.min(iteration).alias("_first"))
    fresh = first.groupBy(session, F.col("_first").alias(iteration)).agg(F.count("*").alias("_new"))
    steps = usage.select(session, iteration).distinct().join(fresh, [session, iteration], "left").withColumn("new_chunks", F.coalesce("_new", F.lit(0))).drop("_new")
    run = Window.partitionBy(session).orderBy(iteration).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = pool.groupBy(session).agg(F.count_distinct(id_col).alias("total_chunks"))
    return steps.withColumn("used_chunks", F.sum("new_chunks").over(run)).join(totals, session).withColumn("coverage_pct", F.round(100.0 * F.col("used_chunks") / F.col("total_chunks"), 2))


def session_documents(chunks: DataFrame) -> DataFrame:
    """(session_id, document_uuid, chunks, words) and the session's total."""
    by_doc = chunks.groupBy("session_id", "document_uuid").agg(F.count("*").alias("chunks"), F.sum("chunk_size").alias("words"))
    return by_doc.withColumn("session_chunks", F.sum("chunks").over(Window.partitionBy("session_id")))


@dataclass
class Cache:
    """Hot and cold sets of one session, moved between turns; ids are taken in order, so results do not depend on set order."""

    capacity: int = 5
    preload: int = 5
    offload_limit: int = 5
    hot: list[str] = field(default_factory=list)
    cold: list[str] = field(default_factory=list)
    protected: set[str] = field(default_factory=set)
    hits: int = 0
    misses: int = 0

    def start(self, chunks: list[str]) -> None:
        self.cold = list(dict.fromkeys(chunks))
        self.hot = self.cold[: self.preload]

    def prefetch(self, neighbours: list[str], wanted: list[str], count: int = 3) -> list[str]:
        """Load up to count chunks ahead: graph neighbours, else cold chunks that are neither hot nor wanted, else the context itself."""
        spare = [c for c in self.cold if c not in set(self.hot) | set(wanted)]
        picked = (neighbours or spare or wanted)[:count]
        loaded = [c for c in picked if c in set(self.cold) and c not in set(self.hot)][: max(0, self.capacity - len(self.hot))]
        self.hot = self.hot + loaded
        return loaded

    def evict(self, marked: list[str], used_gb: float, limit_gb: float) -> int:
        """Forget marked cold chunks that are not hot once memory use reaches the limit; how many went."""
        if used_gb < limit_gb:
            return 0
        gone = set(marked) & set(self.cold) - set(self.hot)
        self.cold = [c for c in self.cold if c not in gone]
        return len(gone)

    def turn(self, wanted: list[str], free_ratio: float = 1.0) -> dict:
        """One turn: count hits before anything moves, offload outdated chunks under pressure, else load what is missing."""
        now = list(dict.fromkeys(wanted))
        hits = sum(c in set(self.hot) for c in now)
        self.hits, self.misses = self.hits + hits, self.misses + len(now) - hits
        outdated = sorted(set(self.hot) - set(now) - self.protected)
        missing = [c for c in now if c not in set(self.hot)]
        pressed = free_ratio <= 0.15 or len(self.hot) + len(missing) > self.capacity
        if pressed and outdated:
            gone = set(outdated[: self.offload_limit])
            self.hot, action, moved = [c for c in self.hot if c not in gone], "offload", len(gone)
        elif missing:
            room = missing[: max(0, self.capacity - len(self.hot))]
            self.hot, action, moved = self.hot + room, "load", len(room)
        else:
            action, moved = "none", 0
        return {"hits": hits, "misses": len(now) - hits, "action": action, "moved": moved, "hot": len(self.hot), "hit_rate": round(self.hits / max(1, self.hits + self.misses), 3)}


def simulate_cache(turns: DataFrame, session: str, iteration: str, wanted: str, capacity: int = 5) -> DataFrame:
    """The cache's figures after every turn of turns(session, iteration, wanted array<string>); sessions are independent."""
    kinds = dict(turns.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(iteration)
        cache = Cache(capacity)
        cache.start([c for w in rows[wanted] if w is not None for c in w])
        made = [{session: s, iteration: i, **cache.turn(list(w) if w is not None else [])} for s, i, w in zip(rows[session], rows[iteration], rows[wanted], strict=True)]
        return pd.DataFrame(made, columns=[session, iteration, "hits", "misses", "action", "moved", "hot", "hit_rate"])

    return turns.groupBy(session).applyInPandas(run, f"{session} {kinds[session]}, {iteration} {kinds[iteration]}, hits long, misses long, action string, moved long, hot long, hit_rate double")


def cache_summary(turns: DataFrame, session: str) -> DataFrame:
    """Hit rate in per cent, swaps, and chunks moved a swap, from simulate_cache()."""
    hits, misses = F.sum("hits"), F.sum("misses")
    mean = lambda action: F.coalesce(F.round(F.avg(F.when(F.col("action") != "none", F.when(F.col("action") == action, F.col("moved")).otherwise(0))), 2), F.lit(0.0))
    return turns.groupBy(session).agg(
        F.when(hits + misses > 0, F.round(100.0 * hits / (hits + misses), 2)).otherwise(F.lit(0.0)).alias("hit_rate_pct"), F.count_if(F.col("action") != "none").alias("swaps"), mean("load").alias("avg_loaded"), mean("offload").alias("avg_offloaded"), F.max("hot").alias("peak_hot"),
    )
