"""Exact vector search in blocks, embedders, and pairs above a similarity."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions import vectors as V

#: Queries that go to the executors at once; a larger query set is taken in blocks.
QUERIES_AT_ONCE = 4096
#: Products of queries and rows that a task has in memory at once.
CELLS_AT_ONCE = 1 << 20
#: Texts whose tokens are hashed at once.
TEXTS_AT_ONCE = 2048
DIM = 64
#: Vectors of a block at most, and vectors that are compared with as many at once.
BLOCK, TILE = 32768, 2048


def _hashed(lists: pa.ListArray, dim: int) -> pa.ListArray:
    """Unit vectors of the hashed counts of lists of tokens. Each different token is hashed once; sums of squares are whole numbers, so their order does not show."""
    terms, n = pc.dictionary_encode(lists.flatten()), len(lists)
    buckets = np.array([int(md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms.dictionary.to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.bincount(row * dim + buckets[terms.indices.to_numpy()], minlength=n * dim).reshape(n, dim).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.ravel()))


def hashed_embedding(docs: DataFrame, id_col: str, text: Column, dim: int = DIM) -> DataFrame:
    """(id, embedding): unit vectors of hashed token counts; a text without tokens has a zero vector. They are made where the texts are, and no token is shuffled. Ids are unique."""
    rows = docs.select(id_col, X.tokens(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([batch.column(0), _hashed(batch.column(1), dim)], [id_col, "embedding"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _units(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-8)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, query_vector: str, id_col: str, vector_col: str, not_same: bool = False, query_part: str | None = None, part: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id_col, similarity_score): each query's k most similar vectors by cosine, rounded to 6 digits, ties to the smaller id.

    Each block of queries is held against every row once, as matrix products of at most CELLS_AT_ONCE numbers; a task
    passes on its k best a query, so neither memory nor what is shuffled grows with the number of pairs. With parts, only rows of the query's part count.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(query_id).alias("q"), V.clean(F.col(query_vector)).alias("v"), (F.col(query_part).cast("string") if query_part else F.lit("")).alias("p")).orderBy("q")
    rows = vectors.select(F.col(id_col).alias("id"), V.clean(F.col(vector_col)).alias("v"), (F.col(part).cast("string") if part else F.lit("")).alias("p"))
    kinds = dict(rows.dtypes)["id"], dict(asked.dtypes)["q"]

    def search(block: list) -> DataFrame:
        names = np.array([r.q for r in block])
        parts = np.array([r.p for r in block])
        wanted = _units(np.array([r.v for r in block], dtype=np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for whole in batches:
                for at in range(0, whole.num_rows, max(1, CELLS_AT_ONCE // len(block))):
                    batch = whole.slice(at, max(1, CELLS_AT_ONCE // len(block)))
                    ids = np.array(batch.column("id").to_pylist())
                    near = np.round(wanted @ _units(_matrix(batch.column("v"))).T, 6)
                    barred = parts[:, None] != np.array(batch.column("p").to_pylist())[None, :]
                    if not_same:
                        barred |= names[:, None] == ids[None, :]
                    near[barred] = -np.inf
                    take = np.argsort(ids, kind="stable")
                    order = take[np.argsort(-near[:, take], axis=1, kind="stable")[:, :k]]
                    found = ids[order], np.take_along_axis(near, order, axis=1)
                    if best is not None:
                        both = [np.concatenate(x, axis=1) for x in zip(best, found, strict=True)]
                        order = np.lexsort((both[0], -both[1]), axis=1)[:, :k]
                        found = tuple(np.take_along_axis(x, order, axis=1) for x in both)
                    best = found
            if best is not None:
                keep = best[1] > (-np.inf if least is None else least)
                row = np.nonzero(keep)[0]
                yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist()), pa.array(best[0][keep].tolist()), pa.array(best[1][keep])], ["q", "id", "similarity_score"])

        return rows.mapInArrow(run, f"q {kinds[1]}, id {kinds[0]}, similarity_score double")

    found, block = spark.createDataFrame([], f"q {kinds[1]}, id {kinds[0]}, similarity_score double"), []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == QUERIES_AT_ONCE:
            found, block = found.unionByName(search(block)), []
    if block:
        found = found.unionByName(search(block))
    order = Window.partitionBy("q").orderBy(F.desc("similarity_score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "similarity_score", "rank")


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = BLOCK) -> DataFrame:
    """(a, b, similarity): pairs a < b of distinct vectors with cosine above least; equal vectors stand as the smallest of their ids.

    Vectors are dealt over blocks of bounded size by hash, as few as hold them and keep all cores at work, since each vector is shuffled once a block; a task compares two blocks
    by matrix products of bounded size and passes on the pairs found, so no table of all pairs is made.
    """
    good = vectors.where(F.col(vector_col).isNotNull()).groupBy(V.clean(F.col(vector_col)).alias("v")).agg(F.min(id_col).alias("id"))
    n, cores = good.count(), vectors.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-n // cell), min(-(-n // 512), int((8 * cores) ** 0.5) + 1))
    dealt = good.select("id", "v", F.expr(f"cast(pmod(xxhash64(id), {cells}) as int)").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("other"))
    dealt = dealt.select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = dict(good.dtypes)["id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        ids, x = table.column("id").to_numpy(), _units(_matrix(table.column("v").combine_chunks()))
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        for p in range(0, len(left), TILE):
            for q in range(p if i[0] == j[0] else 0, len(right), TILE):
                some, others = left[p : p + TILE], right[q : q + TILE]
                near = np.round(x[some] @ x[others].T, 6)
                a, b = np.nonzero(near > least)
                score, a, b = near[a, b], ids[some[a]], ids[others[b]]
                keep = (a < b) if i[0] == j[0] and p == q else np.ones(len(a), bool)
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (np.minimum(a, b), np.maximum(a, b), score)], ["a", "b", "similarity"])

    compare.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, node): rows with equal vectors stand as the one with the smallest id; null vectors are in no class."""
    good = vectors.where(F.col(vector_col).isNotNull()).select(id_col, V.clean(F.col(vector_col)).alias("_v"))
    return good.join(good.groupBy("_v").agg(F.min(id_col).alias("node")), "_v").select(id_col, "node")


def all_pairs(vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = BLOCK) -> DataFrame:
    """(a, b, similarity): all pairs a < b with cosine above least, copies included; only different vectors are compared.

    The members of a class have the pairs of its representative, and those among themselves.
    """
    members = vector_classes(vectors, id_col, vector_col).select(F.col(id_col).alias("m"), "node")
    apart = similar_pairs(vectors, least, id_col, vector_col, cell)
    if members.where("m <> node").isEmpty():
        return apart
    x, y = (members.select(F.col("node").alias(side), F.col("m").alias(f"_{side}")) for side in "ab")
    apart = apart.join(x, "a").join(y, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity")
    v = V.clean(F.col(vector_col))
    alike = vectors.select(F.col(id_col).alias("node"), F.round(V.cosine(v, v), 6).alias("similarity")).join(members.where("m = node").select("node").distinct(), "node", "left_semi")
    alike = alike.where(F.col("similarity") > least).join(members.select("node", F.col("m").alias("a")), "node").join(members.select("node", F.col("m").alias("b")), "node").where("a < b")
    return apart.unionByName(alike.select("a", "b", "similarity"))
