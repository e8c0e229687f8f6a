"""Hard negatives by one-dimensional distance keys, exact.

Whole-number vectors get one more component that makes all of them equally long, so that the largest inner product with an anchor is the smallest distance from
it. Each vector belongs to its nearest pivot, and the index is stored sorted by (pivot, distance to the pivot) in pages. By the triangle inequality a page's interval
of keys bounds the scores that an anchor can find in it. An anchor scans the pages whose intervals are nearest to its own key, then ever wider
rings of them, until no page that is left can hold a score above its worst: the k best are then certain. Anchors travel to the pages in packed rows, each task keeps
the best of what it scans, and a pair of vectors is never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, pieces, store

#: Pivots, and the rows of the bounded sample that they are fitted on.
PIVOTS, SAMPLE = 32, 4096
#: Rows of a page; pages that the directory has before pages grow; rows of a page at most.
PAGE, DIRECTORY, MOST_PAGE = 1024, 32_768, 1 << 18
#: Pages of the first ring, growth of the rings, anchors in one packed row.
FIRST, WIDER, ANCHORS = 4, 4, 64
#: Components are held within 2**24 of zero: scores of vectors up to 16,384 long stay whole numbers of 64 bits.
HELD = 1 << 24
#: No bound on scores.
FAR = 1 << 62


class Index(NamedTuple):
    pages: DataFrame
    #: Pivots, as {width: array with the added component last}; the square of the common length.
    pivots: dict[int, np.ndarray]
    square: dict[int, float]


def whole(vector: Column) -> Column:
    """floor(256 x) of each component, x as double, held within HELD."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(float(-HELD))), F.lit(float(HELD)))))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vectors."""
    widths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(widths):
        rows = np.flatnonzero(widths == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]].astype(np.int64)


def _added(x: np.ndarray, square: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(0.0, square - (x * x).sum(axis=1)))[:, None]))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T))


def fit_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 4) -> np.ndarray:
    """Means of the nearest sample rows, from first pivots that are far from each other."""
    at = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[at[-1:]])[:, 0])
    pivots = sample[at]
    for _ in range(rounds):
        own = _distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[own == i].mean(axis=0) if (own == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


def _keys(pivots: dict[int, np.ndarray], square: dict[int, float]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            for rows, x in _by_width(batch):
                d = x.shape[1]
                apart = _distances(_added(x, square[d]), pivots[d])
                own = apart.argmin(axis=1)
                raw = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
                taken = [batch.column(c).take(pa.array(rows)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d), pa.int32()), pa.array(own.astype(np.int32)), pa.array(apart[np.arange(len(rows)), own]), *taken, raw], ["width", "pivot", "key", "id", "label", "vector"])

    return keys


_PAGE = "page long, kind int, width int, pivot int, low double, high double, ids array<long>, labels array<long>, vectors binary, lows array<long>, highs array<long>"
_PAGE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_PAGE_NAMES = [x.split()[0] for x in _PAGE.split(", ")]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_PAGE_KINDS)], _PAGE_NAMES)


def _paged(size: int):
    """Rows come sorted by (width, pivot, key); a page holds rows of one pivot, by id."""

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held, group, count = TaskContext.get().partitionId() << 32, 0, [], None, 0

        def page() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("id").combine_chunks()
            keys, raw = rows.column("key").to_numpy(), b"".join(rows.column("vector").to_pylist())
            return _packed([(first + made, 0, *group, keys.min(), keys.max(), rows.column("id").to_numpy(), rows.column("label").to_numpy(), raw, [], [])])

        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.stack([batch.column(c).to_numpy() for c in ("width", "pivot")], axis=1)
            turns = np.flatnonzero((both[1:] != both[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *turns.tolist()], [*turns.tolist(), len(both)], strict=True):
                while a < z:
                    if group is not None and (group != (int(both[a, 0]), int(both[a, 1])) or count == size):
                        yield page()
                        made, held, count = made + 1, [], 0
                    group = int(both[a, 0]), int(both[a, 1])
                    n = min(z - a, size - count)
                    held.append(batch.slice(a, n))
                    a, count = a + n, count + n
        if held:
            yield page()

    return paged


def build(rows: DataFrame) -> Index:
    """The stored index of rows (id long, label long, vector array<long>), none of them null."""
    spark = rows.sparkSession
    squares = rows.select(F.size("vector").alias("width"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"))
    sizes = {r.width: (r.n, r.square) for r in squares.groupBy("width").agg(F.count("*").alias("n"), F.max("square").alias("square")).collect()}
    square = {d: s for d, (_, s) in sizes.items()}
    sample = rows.select("vector", F.xxhash64("id", "vector").alias("order")).orderBy("order").limit(SAMPLE).toArrow()
    by_width: dict[int, list] = {}
    for batch in sample.to_batches():
        for _, x in _by_width(batch):
            by_width.setdefault(x.shape[1], []).append(x)
    pivots = {d: fit_pivots(_added(np.concatenate(by_width[d]), square[d])) if d in by_width else np.zeros((1, d + 1)) for d in square}
    size = min(MOST_PAGE, max(PAGE, -(-sum(n for n, _ in sizes.values()) // DIRECTORY)))
    keyed = rows.mapInArrow(_keys(pivots, square), "width int, pivot int, key double, id long, label long, vector binary")
    # Rows of one key are dealt by id: many equal vectors are many pages.
    order = ["width", "pivot", "key", F.xxhash64("id")]
    return Index(store(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_paged(size), _PAGE), "neg-index"), pivots, square)


class Directory(NamedTuple):
    """Of the pages of one width: number, pivot, and the interval of keys."""

    page: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray


def directory(index: Index) -> dict[int, Directory]:
    """A few numbers a page; DIRECTORY pages at most until pages have MOST_PAGE rows."""
    found = index.pages.select("width", "page", "pivot", "low", "high").toArrow().sort_by("page")
    width = found.column("width").to_numpy()
    return {int(d): Directory(*(found.column(c).to_numpy()[width == d] for c in ("page", "pivot", "low", "high"))) for d in np.unique(width)}


def bounds(x: np.ndarray, known: Directory, pivots: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score that each row of x can have with a vector of each page."""
    q = np.hstack((x.astype(np.float64), np.zeros((len(x), 1))))
    own = _distances(q, pivots)[:, known.pivot]
    least = np.maximum(0.0, np.maximum(own - known.high, known.low - own))
    level = ((q * q).sum(axis=1) + square)[:, None]
    slack = 1 + 1e-6 * level
    return (level - (own + known.high) ** 2) / 2 - slack, (level - least**2) / 2 + slack


def _asks(known: dict[int, Directory], index: Index, start: int, reach: int):
    """Packed anchors for the pages of this ring; a row of kind 2 says that pages outside of it are still open."""
    pivots, square = index.pivots, index.square

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ANCHORS):
            ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
            lows, highs = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("lows", "highs"))
            for rows, x in _by_width(batch):
                if (d := x.shape[1]) not in known:
                    continue
                pages = known[d]
                step = max(1, (1 << 21) // len(pages.page))
                for at in range(0, len(rows), step):
                    part, own = x[at : at + step], rows[at : at + step]
                    least, most = bounds(part, pages, pivots[d], square[d])
                    open_ = np.zeros(least.shape, np.bool_)
                    for low, high in zip(lows[own].T, highs[own].T, strict=True):
                        open_ |= (low <= high)[:, None] & (most >= low[:, None]) & (least <= high[:, None])
                    place = np.empty(most.shape, np.int64)
                    np.put_along_axis(place, np.argsort(-most, axis=1, kind="stable"), np.arange(most.shape[1])[None, :], axis=1)
                    now = open_ & (place >= start) & (place < reach)
                    raw, made = part.astype("<i4"), []
                    for p in np.flatnonzero(now.any(axis=0)):
                        who = np.flatnonzero(now[:, p])
                        made.append((pages.page[p], 1, d, None, None, None, ids[own[who]], labels[own[who]], raw[who].tobytes(), lows[own[who]].ravel(), highs[own[who]].ravel()))
                        if len(made) == 256:
                            yield _packed(made)
                            made = []
                    if (open_ & (place >= reach)).any():
                        made.append((-1, 2, d, None, None, None, [], [], None, [], []))
                    if made:
                        yield _packed(made)

    return asks


def _best(scores: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best allowed scores from low to high; of equal scores the first columns."""
    kept = np.where(allowed & (scores >= low[:, None]) & (scores <= high[:, None]), scores, -FAR)
    if kept.shape[1] > k:
        worst = np.partition(kept, kept.shape[1] - k, axis=1)[:, kept.shape[1] - k]
        row, col = np.nonzero((kept >= worst[:, None]) & (kept > -FAR))
    else:
        row, col = np.nonzero(kept > -FAR)
    order = np.lexsort((col, -kept[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def _visit(k: int, same: bool, exact: bool):
    """Rows come sorted by page, the page itself before the anchors that ask for it. exact: products of floats are whole numbers below 2**53."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = labels = vectors = at = None
        for batch in batches:
            for r in range(batch.num_rows):
                page, kind, d = (batch.column(c)[r].as_py() for c in ("page", "kind", "width"))
                own, own_labels = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                x = np.frombuffer(batch.column("vectors")[r].as_py(), "<i4").reshape(len(own), d).astype(np.float64 if exact else np.int64)
                if kind == 0:
                    at, ids, labels, vectors = page, own, own_labels, x
                    continue
                if at != page:
                    raise RuntimeError(f"page {page} is missing")
                lows, highs = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(len(own), -1) for c in ("lows", "highs"))
                # A large page is taken in parts; the scores of a part and all anchors of the row are held.
                for a in range(0, len(ids), 4096):
                    part = slice(a, a + 4096)
                    scores = x @ vectors[part].T
                    allowed = ((own_labels[:, None] == labels[None, part]) == same) & (own[:, None] != ids[None, part])
                    for w in range(lows.shape[1]):
                        row, col = _best(scores, allowed, lows[:, w], highs[:, w], k)
                        if len(row):
                            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(np.full(len(row), w), pa.int32()), pa.array(ids[part][col]), pa.array(scores[row, col].astype(np.int64))], ["id", "win", "found", "score"])

    return visit


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(id, win, rank, found, score): of each anchor and each of its ranges of scores the k best rows of its own label (same) or of others.

    anchors (id, label, vector array<long>, lows, highs) is stored and has equally many ranges for all. Higher scores come first, then smaller ids; the
    anchor's own id is never found. Rows that are repeated count each.
    """
    known, start, reach = directory(index), 0, FIRST
    exact = max(index.square.values(), default=0.0) < 2**53
    found, now = None, anchors
    best = Window.partitionBy("id", "win").orderBy(F.desc("score"), "found")
    while True:
        asks = store(now.select("id", "label", "vector", "lows", "highs").mapInArrow(_asks(known, index, start, reach), _PAGE), "neg-asks")
        if asks.isEmpty():
            break
        asked = asks.where("kind = 1")
        pages = index.pages.join(F.broadcast(asked.select("page").distinct()), "page", "left_semi")
        rows = pages.select(*_PAGE_NAMES).unionByName(asked).repartition("page").sortWithinPartitions("page", "kind")
        new = rows.mapInArrow(_visit(k, same, exact), "id long, win int, found long, score long")
        both = new if found is None else new.unionByName(found.drop("rank"))
        after = store(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "neg-found", *([found] if found is not None else []), asks)
        found = after
        # Only a score above the worst of k, or one equal to it with a smaller id, can still come in.
        worst = found.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("worst"))
        floor = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at(F.col("worst"), i), low)))
        now = anchors.join(worst, "id", "left").withColumn("lows", F.when(F.col("worst").isNull(), F.col("lows")).otherwise(floor))
        start, reach = reach, reach * WIDER
    discard(asks)
    return found if found is not None else anchors.sparkSession.createDataFrame([], "id long, win int, found long, score long, rank int")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor, of components floor(256 x). An anchor's positives are its first `positives` other rows of the same label; for each of
    them come the first `negatives` rows of other labels whose score is from low to high percent of the positive's. Higher scores come first, ties go to the smaller id.
    Rows with null id or label, a null vector, or a null or non-finite component take no part. Components over 2**16 in size (2**24 after scaling) count as that. Vectors of
    different lengths never meet. Rows that are repeated are candidates each; of anchors with one id the least row is taken. Anchors without positives, and positives
    without negatives in range, have no rows; an empty table gives none. Other columns play no part.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    good = good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("vector", whole(F.col("v"))).drop("v")
    good = store(good, "neg-rows")
    index = build(good.select("id", "label", "vector"))
    anchors = good.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    anchors = store(anchors.withColumns({"lows": F.array(F.lit(-FAR)), "highs": F.array(F.lit(FAR))}), "neg-anchors")
    near = search(index, anchors, True, positives)
    score = F.col("score").cast("decimal(38,0)")
    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    ranges = near.select("id", (F.col("rank") - 1).alias("win"), down(score * low + 99).alias("low"), down(score * high).alias("high"))
    # Places without a positive get an empty range.
    listed = ranges.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("win", F.struct("low", "high")))).alias("by"))
    each = F.sequence(F.lit(0), F.lit(positives - 1))
    windows = {"lows": F.transform(each, lambda i: F.coalesce(F.try_element_at(F.col("by"), i)["low"], F.lit(1).cast("long"))), "highs": F.transform(each, lambda i: F.coalesce(F.try_element_at(F.col("by"), i)["high"], F.lit(0).cast("long")))}
    asked = store(anchors.drop("lows", "highs").join(listed, "id").withColumns(windows).drop("by"), "neg-anchors", anchors)
    far = search(index, asked, False, negatives)
    a, b = near.select("id", (F.col("rank") - 1).alias("win"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), far.select("id", "win", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return a.join(b, ["id", "win"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
