"""Removal of long repeated byte strings by prefix-free parsing.

Parsing. A rolling hash of WORD bytes is taken at every position of a text; the least one inside a LENGTH-byte string is
that string's trigger. Successive strings with the same trigger form a phrase: the bytes from the first
string's start to the last one's end. Phrases overlap by LENGTH - 1 bytes, so each string lies whole in exactly
one phrase, and where it is cut depends on its own bytes alone: equal strings have equal triggers.

Dictionary and parse. Phrases that are equal (by 128 bits of hashes) are one entry of the dictionary; the parse lists where entries
occur. A trigger that occurs once has no repeated string, and an entry that occurs twice has no other. What is left are
entries of triggers that have several: a suffix array over their bytes, made by prefix doubling, ranks every suffix that has LENGTH bytes by these,
so equal ranks are equal strings, compared byte by byte. Corpus order is that of the ranks, each suffix standing for as many places
as the parse has of its entry; a string is repeated if its rank has two places or more. The order among the places of one rank
is never asked for, so the parse is counted and not sorted by what follows.

Size. Work on unique text ends with the count of triggers. Suffix arrays are made for buckets, all entries of a trigger, in blocks of bounded
bytes. A trigger with more than BUCKET entries (a passage that very many texts have, each with other surroundings) is subdivided: its
entries are cut into sections by their distance to the trigger, equal sections are merged, and sections with the same core form the buckets. Should such a
bucket still be too large, its strings are counted one by one by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import pieces, store

LENGTH, WORD = 200, 40
#: Bytes of texts that are parsed at once; a position must fit in POSITION_BITS.
SEGMENT, POSITION_BITS = 4 << 20, 24
#: A place is one long: the start, then the number of strings, then 16 bits that identify the text along with its hash h.
STRING_BITS, TAG_BITS = 12, 16
#: Strings of a section; entries of a bucket; bytes of entries that get one suffix array.
SECTION, BUCKET, BLOCK_BYTES = 16, 4096, 1 << 20


def word_of(length: int) -> int:
    """Bytes of a trigger; ValueError for a length whose phrases could not be numbered."""
    word = min(WORD, -(-length // 2))
    if length < 1 or length - word + 1 >= 1 << STRING_BITS:
        raise ValueError(f"length must be from 1 to {word + (1 << STRING_BITS) - 2}")
    return word


def _least(data: np.ndarray, length: int, word: int) -> tuple[np.ndarray, np.ndarray]:
    """(rolling hashes, position of the least one of each length-byte string); of equal hashes the first counts."""
    rolled = kernels.rolling(data, word)
    least = ((rolled >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS)) | np.arange(len(rolled), dtype=np.uint64)
    reach, want = 1, length - word + 1
    while reach * 2 <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < want:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    return rolled, (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def phrases(texts: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(number of the text, trigger, two hashes of the phrase, start, strings) of the phrases of some texts; those shorter than length have none."""
    word, cut = word_of(length), []
    for i, data in enumerate(texts):
        cut += [(i, at, data[at : at + SEGMENT + length - 1]) for at in range(0, len(data) - length + 1, SEGMENT)]
    found, open_, size = [], [], 0
    for part in [*cut, None]:
        if open_ and (part is None or size + len(part[2]) > SEGMENT):
            found.append(_buffer(open_, length, word))
            open_, size = [], 0
        if part is not None:
            open_.append(part)
            size += len(part[2])
    if not found:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _buffer(parts: list[tuple[int, int, np.ndarray]], length: int, word: int) -> tuple[np.ndarray, ...]:
    data, sizes = np.concatenate([p[2] for p in parts]), np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    rolled, at = _least(data, length, word)
    starts = np.repeat(begin - np.cumsum(sizes - length + 1) + (sizes - length + 1), sizes - length + 1) + np.arange((sizes - length + 1).sum())
    at = at[starts]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [len(at)])))
    a = starts[first]
    z = a + count - 1 + length
    part = np.searchsorted(begin, a, side="right") - 1
    own, offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return own[part], rolled[at[first]], kernels.span_hashes(data, a, z, 1), kernels.span_hashes(data, a, z, 2), a - begin[part] + offset[part], count


def _place(start: np.ndarray, strings: np.ndarray | int, tag: np.ndarray | int) -> np.ndarray:
    return (start << (STRING_BITS + TAG_BITS)) | (strings << TAG_BITS) | tag


def _parts_of(place: int) -> tuple[int, int, int]:
    """(start, strings, tag)."""
    return place >> (STRING_BITS + TAG_BITS), (place >> TAG_BITS) & ((1 << STRING_BITS) - 1), place & ((1 << TAG_BITS) - 1)


def _parse(length: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            text, trigger, p, q, start, count = phrases([kernels.byte_array(t.as_py()) for t in batch.column("text")], length)
            place = _place(start, count, batch.column("g").to_numpy()[text])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (trigger, p, q)), batch.column("h").take(pa.array(text)), pa.array(place)], ["trigger", "p", "q", "h", "place"])

    return parse


def _entries(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(bucket, trigger, n, h, tag, start, strings, bytes) of all entries of all texts; None after each batch."""
    for batch in pieces(batches, 64):
        for h, text, entries in zip(batch.column("h").to_pylist(), batch.column("text"), batch.column("entries").to_pylist(), strict=True):
            data = kernels.byte_array(text.as_py())
            for e in entries:
                start, strings, tag = _parts_of(e["place"])
                yield e["bucket"], e["trigger"], e["n"], h, tag, start, strings, data[start : start + strings - 1 + length]
        yield None


def _batched(length: int, names: list[str], made):
    """A function for mapInArrow that gives made() entries of about BLOCK_BYTES at once: columns of entries, their bytes, begins and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def done() -> pa.RecordBatch:
            _, trigger, n, h, tag, start, strings, _ = (np.array(c, dtype=np.int64) if i < 7 else None for i, c in enumerate(zip(*rows, strict=True)))
            sizes = strings - 1 + length
            found = made({"trigger": trigger, "n": n, "h": h, "tag": tag, "start": start, "strings": strings}, np.concatenate([r[-1] for r in rows]), np.cumsum(sizes) - sizes)
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in found], names)

        for entry in _entries(batches, length):
            if entry is not None:
                rows.append(entry)
                size += len(entry[-1])
                if size >= BLOCK_BYTES:
                    yield done()
                    rows, size = [], 0
        if rows:
            yield done()

    return run


def _strings_of(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, number within it) of the strings of all entries."""
    return np.repeat(np.arange(len(strings)), strings), np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)


def _sections(length: int):
    """Entries cut into sections: strings whose distance to the trigger has the same quotient by SECTION.

    All strings of a section hold its core, bytes whose place depends on the trigger alone; the hashes p and q are of all bytes of the section.
    """
    word, section = word_of(length), min(SECTION, length)

    def made(e: dict[str, np.ndarray], data: np.ndarray, begin: np.ndarray) -> tuple:
        at = np.arange(length - word + 1)
        key = kernels.rolling(data, word)[begin[:, None] + at[None, :]]
        spot = (((key >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS)) | at.astype(np.uint64)).argmin(axis=1)
        entry, j = _strings_of(e["strings"])
        number = (spot[entry] - j) // section
        first = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (entry[1:] != entry[:-1]))))
        count, entry, j, number = np.diff(np.concatenate((first, [len(number)]))), entry[first], j[first], number[first]
        core, a = begin[entry] + spot[entry] - section * number, begin[entry] + j
        z = a + count - 1 + length
        hashes = [kernels.span_hashes(data, core, core + length - section + 1, 3), kernels.span_hashes(data, a, z, 1), kernels.span_hashes(data, a, z, 2)]
        return e["trigger"][entry], e["n"][entry], e["h"][entry], number, *hashes, _place(e["start"][entry] + j, count, e["tag"][entry])

    return _batched(length, ["trigger", "n", "h", "section", "core", "p", "q", "place"], made)


def _strings(length: int):
    """The strings of entries, each with its two hashes."""

    def made(e: dict[str, np.ndarray], data: np.ndarray, begin: np.ndarray) -> tuple:
        entry, j = _strings_of(e["strings"])
        a = begin[entry] + j
        return e["n"][entry], e["h"][entry], kernels.span_hashes(data, a, a + length, 1), kernels.span_hashes(data, a, a + length, 2), _place(e["start"][entry] + j, 1, e["tag"][entry])

    return _batched(length, ["n", "h", "p", "q", "place"], made)


def _bytes_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for entry in _entries(batches, length):
            if entry is not None:
                bucket, _, n, h, tag, start, strings, data = entry
                rows.append((bucket, n, h, (start << (STRING_BITS + TAG_BITS)) | (strings << TAG_BITS) | tag, data.tobytes()))
            elif rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "n", "h", "place", "bytes"])
                rows = []

    return run


def suffix_ranks(data: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes of a concatenation by their first `length` bytes; left: bytes from each position to the end of its entry.

    Prefix doubling: ranks by h bytes make ranks by up to 2 h bytes. Suffixes shorter than that get no rank (-1) and are passed over.
    """
    size = min(8, length)
    eights = np.ndarray((len(data),), dtype=">u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    rank, have = np.full(len(data), -1, dtype=np.int64), np.flatnonzero(left >= size)
    rank[have] = np.unique(eights[have].astype(np.uint64) >> np.uint64(8 * (8 - size)), return_inverse=True)[1]
    while size < length:
        step = min(size, length - size)
        have = have[left[have] >= size + step]
        joined = np.unique(rank[have] * np.int64(len(data) + 1) + rank[have + step], return_inverse=True)[1]
        rank[:] = -1
        rank[have] = joined
        size += step
    return rank


def _repeated(entries: list[tuple], length: int) -> list[tuple]:
    """(h, place) of the runs of strings, in entries (n, h, place, bytes) that the parse has once, whose rank has two places or more."""
    sizes = np.array([len(e[3]) for e in entries])
    data = np.frombuffer(b"".join(e[3] for e in entries), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(data))
    rank = suffix_ranks(data, left, length)
    whole = np.flatnonzero(rank >= 0)
    owner = np.repeat(np.arange(len(entries)), sizes - length + 1)
    n = np.array([e[0] for e in entries])
    again = np.bincount(rank[whole], weights=np.minimum(n[owner], 2))[rank[whole]] >= 2
    again &= n[owner] == 1
    edge = np.flatnonzero(again & ~(np.concatenate(([False], again[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1]))))
    stop = np.flatnonzero(again & ~(np.concatenate((again[1:], [False])) & np.concatenate((owner[1:] == owner[:-1], [False]))))
    out = []
    for a, z in zip(edge.tolist(), stop.tolist(), strict=True):
        _, h, place, _ = entries[owner[a]]
        start, _, tag = _parts_of(place)
        out.append((h, ((start + int(whole[a] - begin[owner[a]])) << (STRING_BITS + TAG_BITS)) | ((z - a + 1) << TAG_BITS) | tag))
    return out


def _ranked(length: int):
    """Rows come sorted by bucket; whole buckets are put together up to BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            found = _repeated(open_, length)
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["h", "place"])

        for batch in pieces(batches):
            for bucket, *entry in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "h", "place", "bytes")), strict=True):
                if bucket != last and size >= BLOCK_BYTES:
                    yield done()
                    open_, size = [], 0
                last = bucket
                open_.append(tuple(entry))
                size += len(entry[3])
        if open_:
            yield done()

    return run


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = kernels.byte_array(text.as_py())
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                if spans.is_valid and len(spans):
                    starts, strings = (spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + strings - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
                kept = data[~gone].tobytes() if runs else data.tobytes()
                out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """texts(g, h, text), g of TAG_BITS bits and h a hash -> (g, h, start, strings): runs of starts whose length-byte strings occur elsewhere too."""
    g = F.col("place").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("g")

    def with_text(book: DataFrame) -> DataFrame:
        """book(bucket, trigger, n, h, place) with a row for each text that has entries, so a text is handed over once."""
        listed = book.withColumn("g", g).groupBy("g", "h").agg(F.collect_list(F.struct("bucket", "trigger", "n", "place")).alias("entries"))
        return listed.join(texts, ["g", "h"]).select("h", "entries", "text")

    def dictionary(rows: DataFrame, key: list[str], n) -> DataFrame:
        """The distinct entries, each with its places in the parse (n), one of these, and the entries of its key (entries)."""
        book = store(rows.groupBy(*key, "p", "q").agg(F.sum(n).alias("n"), F.first("h").alias("h"), F.first("place").alias("place")), "pfp-book")
        keys = book.groupBy(*key).agg(F.count("*").alias("entries"), F.sum("n").alias("_all")).where("_all > 1").drop("_all")
        return book.join(keys, key)

    parse = store(texts.mapInArrow(_parse(length), "trigger long, p long, q long, h long, place long"), "pfp-parse")
    # Stored, so that the join has a shuffle on either side and a trigger that very many texts have can be split.
    shared = store(parse.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger"), "pfp-shared")
    hits = store(parse.join(shared, "trigger", "left_semi"), "pfp-hits", parse, shared)
    book = store(dictionary(hits, ["trigger"], F.lit(1)), "pfp-dictionary")
    again = store(hits.join(book.where("n > 1").select("trigger", "p", "q"), ["trigger", "p", "q"], "left_semi").select("h", "place"), "pfp-again", hits)

    mixed = book.where("entries > 1").withColumn("bucket", F.col("trigger"))
    cut = store(with_text(mixed.where(F.col("entries") > BUCKET)).mapInArrow(_sections(length), "trigger long, n long, h long, section long, core long, p long, q long, place long"), "pfp-sections")
    key = ["trigger", "section", "core"]
    parts = store(dictionary(cut, key, F.col("n")), "pfp-section-dictionary")
    alike = cut.where("n = 1").join(parts.where("n > 1").select(*key, "p", "q"), [*key, "p", "q"], "left_semi").select("h", "place")
    parts = parts.where("entries > 1").withColumn("bucket", F.xxhash64(*key))

    columns = ["bucket", "trigger", "n", "h", "place"]
    ranked = mixed.where(F.col("entries") <= BUCKET).select(*columns).unionByName(parts.where(F.col("entries") <= BUCKET).select(*columns))
    ranked = with_text(ranked).mapInArrow(_bytes_of(length), "bucket long, n long, h long, place long, bytes binary").repartition("bucket").sortWithinPartitions("bucket")
    ranked = store(ranked.mapInArrow(_ranked(length), "h long, place long"), "pfp-ranked")

    strings = store(with_text(parts.where(F.col("entries") > BUCKET).select(*columns)).mapInArrow(_strings(length), "n long, h long, p long, q long, place long"), "pfp-strings")
    common = strings.groupBy("p", "q").agg(F.sum("n").alias("n")).where("n > 1").select("p", "q")
    single = strings.where("n = 1").join(common, ["p", "q"], "left_semi").select("h", "place")
    spots = again.unionByName(alike).unionByName(ranked).unionByName(single)
    return spots.select(g, "h", F.shiftright("place", STRING_BITS + TAG_BITS).alias("start"), F.shiftright("place", TAG_BITS).bitwiseAND(F.lit((1 << STRING_BITS) - 1)).cast("int").alias("strings"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Removed is each byte that lies in a length-byte string which also starts anywhere else, be it in the same
    text; matches never cross texts. A null text is empty; texts shorter than length stay whole; texts of any length are taken whole, SEGMENT
    bytes at a time. Repeated rows, ids included, are copies of each other, and null ids are ids like others. Other columns play no part. An empty
    table gives no rows; a length under 1 or over 4,134 is a ValueError.
    """
    word_of(length)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(text, F.col(id_col), F.lit(1)), F.lit(1 << TAG_BITS)).alias("g"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))
    found = repeated_spans(texts.select("g", "h", "text"), length)
    spans = store(found.groupBy("g", "h").agg(F.collect_set(F.struct("start", "strings")).alias("spans")), "pfp-spans")
    whole = texts.join(spans, ["g", "h"], "left").select("id", "text", "spans")
    id_type = dict(texts.dtypes)["id"]
    cut = whole.mapInArrow(_cut(length), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.withColumnRenamed("id", id_col)
