"""Benchmark decontamination by n-gram seeds and local alignment.

All runs of SEED words of the test items are joined with those of all documents: the items' runs, a table of bounded size, are broadcast, and documents
stay where they are. Where a document holds one, the item is
aligned with the words around by Smith-Waterman, and the score is set against that of the unchanged item. No run is
left out as common, since an edited copy may hold no others; a common phrase costs little, as places with too few
of the item's words for the score wanted are passed over before the alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import pieces

SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score from which a document is called contaminated.
LEAK = 0.5
#: Test items that go to the executors at once; more are taken in turn.
ITEMS_AT_ONCE = 20_000

_WORDY = np.zeros(256, dtype=bool)
_WORDY[np.r_[48:58, 97:123, 128:256]] = True


def words(text: str | None) -> np.ndarray:
    """A hash for each word: runs of letters and digits of the lower-cased text, all other than ASCII counting as letters."""
    data = kernels.byte_array((text or "").lower())
    edge = np.diff(np.concatenate(([False], _WORDY[data], [False])).astype(np.int8))
    return kernels.span_hashes(data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of item in text; of equal ones the first to end."""
    n = len(text)
    shift = np.arange(n + 1) * -GAP
    row, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        cross = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        down = row[1:] + GAP
        new, came = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        new[1:] = np.maximum(np.maximum(cross, down), 0)
        came[1:] = np.where(new[1:] == 0, came[1:], np.where(cross >= down, start[:-1], start[1:]))
        lifted = new + shift
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, start = top - shift, came[source]
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(start[end]), end)
    return best


class Seeds:
    """The runs of words of some items, sorted, each with the items and places that have it."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.names = [name for name, _ in items]
        self.words = {i: words(text) for i, (_, text) in enumerate(items)}
        rows = [(h, i, at) for i, w in self.words.items() for at, h in enumerate(self.runs(w).tolist())]
        rows.sort()
        self.where: dict[int, list[tuple[int, int]]] = {}
        for h, i, at in rows:
            self.where.setdefault(h, []).append((i, at))
        self.hashes = np.array(sorted(self.where), dtype=np.uint64)
        self.sizes = sorted({min(SEED, len(w)) for w in self.words.values() if len(w)})

    @staticmethod
    def runs(w: np.ndarray) -> np.ndarray:
        """Runs of SEED words; an item of fewer words is one run, and never found in longer runs of others."""
        return kernels.run_hashes(w, min(SEED, len(w))) if len(w) else w

    def places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in a text, hashes) of the runs that some item has."""
        at, found = [], []
        for n in self.sizes:
            h = kernels.run_hashes(w, n)
            if len(h):
                spot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[spot] == h)
                at.append(hit)
                found.append(h[hit])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _find(shipped, least: float):
    """shipped: the broadcast of Seeds."""

    def pairs(seeds: Seeds, w: np.ndarray) -> Iterator[tuple]:
        starts: dict[int, list[int]] = {}
        for at, h in zip(*(x.tolist() for x in seeds.places(w)), strict=True):
            for i, place in seeds.where[h]:
                starts.setdefault(i, []).append(at - place)
        for i, spots in starts.items():
            item, best = seeds.words[i], (0, 0, 0)
            pad, spots = len(item) // 2 + SEED, sorted(spots)
            first = 0
            for k in range(1, len(spots) + 1):
                if k == len(spots) or spots[k] - spots[k - 1] > 2 * pad:
                    low, high = max(0, spots[first] - pad), min(len(w), spots[k - 1] + len(item) + pad)
                    first = k
                    # No alignment scores more than a match for each word of the item that is there.
                    if np.isin(item, w[low:high]).sum() / len(item) >= least:
                        score, a, b = align(item, w[low:high])
                        best = max(best, (score, -(low + a), low + b))
            share = best[0] / (MATCH * len(item))
            if share >= least:
                yield seeds.names[i], share, -best[1], best[2], len(spots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shipped.value
        for batch in pieces(batches):
            rows, found = [], []
            for n, text in enumerate(batch.column("text")):
                for pair in pairs(seeds, words(text.as_py())):
                    rows.append(n)
                    found.append(pair)
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array([f[c] for f in found], k) for c, k in enumerate(kinds))], ["id", "item", "share", "first", "last", "seeds"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item whose alignment reaches `least` of the best score.

    Columns: id_col, item_col, score (0 to 1), first_word, last_word (the place in the document, the end exclusive), seeds (places with seeds). Null
    and empty texts and items match nothing. Items are told apart by id and text, so texts that share an id, or have none, are each searched; of equal rows one counts. An
    item of fewer than SEED words is one run: every document that has just these words in a row holds it with score 1, be it a single common word, so such
    items belong in `items` only if that is meant. Of places with equal scores the first counts. Texts of any length are searched whole. Repeated rows of docs
    give repeated results. Without documents or items there are no rows. Other columns play no part. Items go to the executors ITEMS_AT_ONCE at a time.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    spec = f"id {frame.schema['id'].dataType.simpleString()}, item long, share double, first long, last long, seeds long"
    out, block = spark.createDataFrame([], spec), []

    def search(block: list) -> DataFrame:
        return frame.mapInArrow(_find(spark.sparkContext.broadcast(Seeds(block)), least), spec)

    for row in asked.orderBy("item", "text").toLocalIterator():
        block.append((row.item, row.text))
        if len(block) == ITEMS_AT_ONCE:
            out, block = out.unionByName(search(block)), []
    if block:
        out = out.unionByName(search(block))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("share").alias("score"), F.col("first").alias("first_word"), F.col("last").alias("last_word"), "seeds")
