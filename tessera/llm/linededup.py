"""Removal of lines that several documents share.

Every task notes the hashes of its lines in two Bloom filters, one of lines seen and one of lines seen again. The filters of all tasks
are merged piece by piece: a bit is seen again if a task says so or if two tasks have seen it. Only lines whose bits are all
seen again are suspected; their digests are shuffled, counted exactly and given the document that keeps the line. A filter never misses a repeat, so its size
changes only how many lines are suspected in vain. It grows with the text up to MOST_BITS; text beyond what that can tell apart makes no filter,
and every line's digest is counted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, free_name, pieces, quoted, store, without

#: Fixed value: what is stripped from the ends of a line.
WHITE = b" \t\n\v\f\r"
#: Bytes of text for a bit of a filter; bits of a filter at most (64 MiB, which is shipped to every task); text for a bit beyond which a filter tells little; bits of a piece.
TEXT_PER_BIT, MOST_BITS, USELESS, PIECE = 16, 1 << 29, 96, 1 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def counts_as_line(key: bytes, least_chars: int) -> bool:
    """Whether a key has least_chars code points."""
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key) - sum(0x80 <= b < 0xC0 for b in key) >= least_chars)


def digest(key: bytes) -> bytes:
    """128 bits of a cryptographic hash stand for a key."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: bytes, least_chars: int) -> list[bytes]:
    """Of the different keys of a text."""
    keys = {line_key(x) for x in text.split(b"\n")}
    return [digest(k) for k in keys if counts_as_line(k, least_chars)]


class Filters:
    """Bits of lines seen and of lines seen again."""

    def __init__(self, bits: int):
        self.mask, self.once, self.twice = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def places(self, digests: list[bytes]) -> np.ndarray:
        """The two bits of each digest."""
        return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2) & self.mask

    def add(self, digests: list[bytes]) -> None:
        """digests: those of several documents, each document's own without repeats."""
        found, times = np.unique(np.frombuffer(b"".join(digests), "V16"), return_counts=True)
        places = found.view("<u8").reshape(-1, 2) & self.mask
        again = (times > 1) | holds(self.once, places)
        put(self.twice, places[again])
        put(self.once, places)


def holds(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether all bits of each row are set."""
    return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(bits: np.ndarray, places: np.ndarray) -> None:
    at = np.unique(places)
    np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _fill(bits: int, least_chars: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None
        for batch in pieces(batches):
            digests = [d for x in batch.column(0) if x.is_valid for d in _digests(x.as_py(), least_chars)]
            if digests:
                filters = filters or Filters(bits)
                filters.add(digests)
        size = min(bits, PIECE) // 8
        for i in range(bits // 8 // size if filters else 0):
            part = slice(i * size, (i + 1) * size)
            if filters.once[part].any():
                packed = [pa.array([zlib.compress(x[part].tobytes(), 1)], pa.binary()) for x in (filters.once, filters.twice)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *packed], ["piece", "once", "twice"])

    return fill


def _merge(size: int):
    """Rows come sorted by piece; the result has the bits that are seen again."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for at, a, b in zip(*(batch.column(c) for c in ("piece", "once", "twice")), strict=True):
                if at.as_py() != now:
                    if now is not None and twice.any():
                        yield made()
                    now, once, twice = at.as_py(), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                more, again = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
                twice |= again | (once & more)
                once |= more
        if now is not None and twice.any():
            yield made()

    return merge


def filter_bits(text_bytes: int, most: int = MOST_BITS) -> int | None:
    """A power of two that grows with the text, or None where `most` bits could tell nothing."""
    bits = 1 << max(13, (text_bytes // TEXT_PER_BIT).bit_length())
    return min(bits, most) if text_bytes <= most * USELESS else None


def repeated_bits(texts: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """(piece, bits): the filter of lines that are seen again, PIECE bits a row; pieces without any are not listed. texts has one binary column."""
    filled = texts.mapInArrow(_fill(bits, least_chars), "piece int, once binary, twice binary")
    return filled.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge(min(bits, PIECE) // 8), "piece int, bits binary")


def _suspect(bits: int | None, shipped, least_chars: int):
    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None
        if bits is not None:
            filters, size = Filters(bits), min(bits, PIECE) // 8
            filters.once = None
            for i, packed in shipped.value:
                filters.twice[i * size : (i + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in pieces(batches):
            row, found = [], []
            for i, x in enumerate(batch.column("text")):
                own = _digests(x.as_py(), least_chars) if x.is_valid else []
                found += own
                row += [i] * len(own)
            if not found:
                continue
            keep = holds(filters.twice, filters.places(found)) if filters else np.ones(len(found), np.bool_)
            at = np.array(row)[keep]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, k in zip(found, keep, strict=True) if k], pa.binary()), batch.column("doc").take(pa.array(at))], ["line", "doc"])

    return suspect


def _drop(least_chars: int, at: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(at).cast(pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                raw, out = (text.as_py() or b""), set(gone.as_py() or ())
                lines = raw.split(b"\n")
                left = [x for x in lines if not (counts_as_line(k := line_key(x), least_chars) and digest(k) in out)] if out else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left) if out else raw)
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_lines", "n_dropped", "kept"])

    return drop


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the text that is left.

    A text is split at \\n; a null or empty one is one empty line. A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
    least least_chars code points that least_docs documents hold lose all their lines except in the document with the largest id; the rest is joined by \\n.
    Rows of one id are one document, and each of them keeps or loses a line alike; rows with null id are one document, smaller than all others. Texts of any length are taken
    whole, by one task each. An empty table stays empty. Columns of docs that are called like a result, in any case of letters, are replaced, others stay.
    """
    spark, mine = docs.sparkSession, ("n_lines", "n_dropped", "kept")
    names = without(docs, [m for m in mine if m not in (text_col.lower(), id_col.lower())])
    place = F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id")).alias("doc")
    texts = docs.select(place, F.col(text_col).cast("binary").alias("text")).where("text is not null")
    bits = filter_bits(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, most_bits)
    shipped = None
    if bits is not None:
        # At most MOST_BITS in all, whatever the input.
        again = repeated_bits(texts.select("text"), bits, least_chars)
        shipped = spark.sparkContext.broadcast([(r.piece, zlib.compress(bytes(r.bits), 1)) for r in again.toLocalIterator()])
    suspects = store(texts.mapInArrow(_suspect(bits, shipped, least_chars), T.StructType([T.StructField("line", T.BinaryType()), texts.schema["doc"]])), "lines-suspects")
    confirmed = store(suspects.groupBy("line").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= least_docs).select("line", "keeper"), "lines-confirmed")
    lost = suspects.join(confirmed, "line").where("doc <> keeper").groupBy("doc").agg(F.collect_set("line").alias("lines"))
    lost = store(lost.select("doc.has", "doc.id", "lines"), "lines-lost", suspects, confirmed)

    frame, out, has = docs.select(*[quoted(c) for c in names]), free_name(docs, "lost_lines"), free_name(docs, "has_id")
    rows = frame.withColumn(has, F.col(id_col).isNotNull())
    same = (rows[has] == lost["has"]) & rows[next(c for c in names if c.lower() == id_col.lower())].eqNullSafe(lost["id"])
    rows = rows.join(lost, same, "left").select(*[rows[c] for c in names], lost["lines"].alias(out))
    at = [c.lower() for c in names].index(text_col.lower())
    kinds = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    return rows.mapInArrow(_drop(least_chars, at), T.StructType([*frame.schema.fields, *kinds]))
