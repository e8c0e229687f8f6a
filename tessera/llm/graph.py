"""Connected components of a link table, on the executors only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, store

#: Links that one task contracts.
LOCAL_LINKS = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of this partition: each node with the smallest node of its part."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = pa.binary()
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "label"])


def components(links: DataFrame, a: str, b: str, local_links: int | None = None) -> DataFrame:
    """(node, label): label is the smallest node that links reach. Nodes without links are not listed.

    links is a stored table. Each partition of it, LOCAL_LINKS at most, is contracted to stars by itself. Where there
    are several, rounds follow: each node takes the smallest label among its neighbours and then that label's own, until nothing changes.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    parts = max(1, -(-pairs.count() // (local_links or LOCAL_LINKS)))
    kind = dict(pairs.dtypes)["a"]
    spread = pairs.coalesce(1) if parts == 1 else pairs.repartition(parts)
    stars = store(spread.mapInArrow(_contract, f"node {kind}, label {kind}"), "cc-stars")
    if parts == 1:
        return stars
    both = stars.select(F.col("node").alias("src"), F.col("label").alias("dst"))
    both = store(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "cc-links")
    labels = store(stars.groupBy("node").agg(F.min("label").alias("label")), "cc-labels", stars)
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = store(step.join(of, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "cc-labels")
        discard(before)
        labels, before = moved.select("node", "label"), moved
        if moved.where("label < old").isEmpty():
            discard(both)
            return labels
