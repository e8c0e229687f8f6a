"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard transforms with random signs rotate each unit vector in every table; its bucket is the nearest
signed axis. A query probes, in each table, the buckets of its nearest signed axes, and at least so many as hold MIN_ROWS
rows, so small tables are searched whole. Vectors of a bucket are dealt over blocks of bounded size; a
query's best of each block are scored exactly, and the best of all blocks are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pieces, store

#: Tables; share of the signed axes that a query probes in each; rotations; vectors of a block.
TABLES, PROBED, ROUNDS, BLOCK = 12, 1 / 32, 3, 4096
#: Rows that the probes of a table reach at least.
MIN_ROWS = 128
QUERIES_AT_ONCE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int = 0) -> np.ndarray:
    """Rows of x, padded with zeros to a power of two, after ROUNDS random sign flips and transforms."""
    width = 1 << max(1, x.shape[1] - 1).bit_length() if x.shape[1] > 1 else 2
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (ROUNDS, width))
    for s in signs:
        y = hadamard(y * s)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision; the result for a pair does not depend on other rows."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1)) / np.sqrt((b * b).sum(axis=1))


def usable(vector: Column) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each length of vectors, components as they are stored."""
    vectors = batch.column("vector")
    widths = np.array(vectors.value_lengths())
    offsets, flat = np.array(vectors.offsets), vectors.values.to_numpy(zero_copy_only=False)
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    for d in np.unique(widths):
        rows = np.flatnonzero(widths == d)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(d)[None, :]]


_POST = "width int, tbl int, bucket int, block int, id long, query boolean, vector binary"


def _posting(tables: np.ndarray, buckets: np.ndarray, blocks: np.ndarray, ids: np.ndarray, query: bool, x: np.ndarray) -> pa.RecordBatch:
    n, size = len(ids), x.shape[1] * x.itemsize
    raw = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    numbers = [pa.array(c.astype(np.int32)) for c in (np.full(n, x.shape[1]), tables, buckets, blocks)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(ids.astype(np.int64)), pa.array(np.full(n, query)), raw], ["width", "tbl", "bucket", "block", "id", "query", "vector"])


def _buckets(y: np.ndarray) -> np.ndarray:
    axis = np.abs(y).argmax(axis=1)
    return 2 * axis + (y[np.arange(len(y)), axis] < 0)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2048):
        for ids, x in _by_width(batch):
            u = unit(x.astype(np.float64))
            for t in range(TABLES):
                yield _posting(np.full(len(ids), t), _buckets(rotate(u, t)), np.zeros(len(ids)), ids, False, x)


def _probe(held: dict[tuple[int, int, int], int]):
    """held: rows of each (width, table, bucket): at most TABLES x 2 x padded width entries for each width."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            for ids, x in _by_width(batch):
                u, width = unit(x.astype(np.float64)), x.shape[1]
                for t in range(TABLES):
                    y = rotate(u, t)
                    signed = np.stack((y, -y), axis=2).reshape(len(y), -1)
                    order = np.argsort(-signed, axis=1, kind="stable")
                    rows = np.array([held.get((width, t, b), 0) for b in range(signed.shape[1])])
                    before = np.cumsum(rows[order], axis=1) - rows[order]
                    wanted = (before < MIN_ROWS) | (np.arange(signed.shape[1]) < np.ceil(signed.shape[1] * PROBED))[None, :]
                    asker, place = np.nonzero(wanted)
                    bucket = order[asker, place]
                    blocks = -(-rows[bucket] // BLOCK)
                    asker, bucket = np.repeat(asker, blocks), np.repeat(bucket, blocks)
                    block = np.arange(len(bucket)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    for at in range(0, len(bucket), 4096):
                        part = slice(at, at + 4096)
                        yield _posting(np.full(len(bucket[part]), t), bucket[part], block[part], ids[asker[part]], True, x[asker[part]])

    return probe


def _rows_of(column: pa.BinaryArray, a: int, z: int, width: int, kind: str) -> np.ndarray:
    """Rows a to z of a column of vectors that all have this width."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset + a], np.frombuffer(offsets, np.int32)[column.offset + z]
    return np.frombuffer(data, np.uint8)[at[0] : at[1]].view(kind).reshape(z - a, width).astype(np.float64)


def _search(k: int, kind: str):
    """Rows come sorted by block, its vectors before its queries."""

    def best(block: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        have, vectors, units = block
        near = unit(q) @ units.T
        near[ids[:, None] == have[None, :]] = -np.inf
        if len(have) > k:
            floor = np.partition(near, len(have) - k, axis=1)[:, len(have) - k] - 1e-9
        else:
            floor = np.full(len(ids), -2.0)
        row, col = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        exact = cosines(q[row], vectors[col])
        order = np.lexsort((have[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.RecordBatch.from_arrays([pa.array(ids[row[keep]]), pa.array(have[col[keep]]), pa.array(exact[keep])], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, block = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("width", "tbl", "bucket", "block")], axis=1)
            query, names = batch.column("query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (query[1:] != query[:-1])) + 1
            for a, z in zip([0, *turns.tolist()], [*turns.tolist(), len(names)], strict=True):
                if (now := tuple(keys[a].tolist())) != key:
                    key, ids, vectors, block = now, [], [], None
                rows = _rows_of(batch.column("vector"), a, z, now[0], kind)
                if not query[a]:
                    ids.append(names[a:z])
                    vectors.append(rows)
                    continue
                if block is None and ids:
                    all_ = np.concatenate(vectors)
                    block = np.concatenate(ids), all_, unit(all_)
                for at in range(0, len(rows) if block else 0, QUERIES_AT_ONCE):
                    yield best(block, names[a:z][at : at + QUERIES_AT_ONCE], rows[at : at + QUERIES_AT_ONCE])

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by cosine of the original vectors, ties to the smaller id.

    Queries are the rows of vectors for which is_query holds; the query's own id is no candidate. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, take no part. Vectors of different lengths are never compared. Repeated ids are one candidate, with the
    best of their scores, and one query. A query without candidates has no rows; an empty table gives none. Other columns play no part.
    """
    spark = vectors.sparkSession
    kind = "f4" if dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<float>" else "f8"
    vector = F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>").alias("vector")
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector, F.coalesce(is_query, F.lit(False)).alias("query"))
    index = store(good.select("id", "vector").mapInArrow(_index, _POST), "ann-index")
    held = {(r.width, r.tbl, r.bucket): r["count"] for r in index.groupBy("width", "tbl", "bucket").count().collect()}
    counts = F.broadcast(spark.createDataFrame([(*key, -(-n // BLOCK)) for key, n in held.items()], "width int, tbl int, bucket int, blocks int"))
    dealt = index.join(counts, ["width", "tbl", "bucket"]).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).drop("blocks").select(*index.columns)
    probes = good.where("query").select("id", "vector").mapInArrow(_probe(held), _POST)
    block = ["width", "tbl", "bucket", "block"]
    rows = dealt.unionByName(probes).repartition(*block).sortWithinPartitions(*block, "query")
    found = rows.mapInArrow(_search(k, kind), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
