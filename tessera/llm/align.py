"""Alignment of two tokenizations of the same bytes.

Both tokenizers cut a text's bytes; a bit is set where a token ends. The AND of the two packed bitsets has the shared cuts,
which split the text into groups of whole tokens of either side. Popcounts in front of a cut (rank) tell which tokens a
group holds; the cuts themselves are listed by select. Tokens that end at a shared cut are linked: a link for each group, the last token of one side with the
last of the other, since a token has one byte at least and so no two tokens of a side end together.

A batch of texts is one bitset. Pairs of token ids that links join are counted over the corpus; a document's links are
then valued by these counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, quoted, store, without

#: The space mark of pieces; byte pieces; how byte-level entries spell the bytes that do not print.
SPACE, BYTE_PIECE = "▁", re.compile("<0x([0-9A-Fa-f]{2})>")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Rows and bytes of text that are tokenized at once; a longer text comes alone.
ROWS, BYTES = 256, 4 << 20
#: Longer texts go through the byte-level file's own merges if they have a run so long of white space or of none: splitting such a run may fail.
LONG_RUN = 100_000
_RUN = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
#: Words whose pieces a task remembers, none of them longer than so many characters.
REMEMBERED, LONG_WORD = 400_000, 64
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Pairs that are counted by a task before it hands them on; pairs that are shipped to all tasks (16 bytes each): more are joined.
HELD_PAIRS, SHIPPED_PAIRS = 2_000_000, 4_000_000
_MADE = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


class Tokens(NamedTuple):
    """Ids of texts in one array, how many each text has, and the bytes of every id."""

    ids: np.ndarray
    sizes: np.ndarray


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens in a text are plain text.

    Where ids go with the order of the merges (checked), words are merged by rank, which is faster and gives the same ids.
    """

    def __init__(self, data: bytes):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_str(data.decode())
        self.slow.encode_special_tokens = True
        model = json.loads(data)["model"]
        letters = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTED))}
        size = self.slow.get_vocab_size(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * size
        for word, at in self.slow.get_vocab(with_added_tokens=True).items():
            self.bytes[at] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        self.fast = self._ranked(json.loads(data), model)

    def _ranked(self, whole: dict, model: dict):
        """An encoder by ranks, or None if the file asks for something else."""
        split = whole.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not whole.get("normalizer") and not model.get("ignore_merges")
        merged = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in merged]
        odd = any(model.get(k) for k in ("byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "dropout"))
        if not plain or odd or made != sorted(set(made)):
            return None
        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ranks = {self.bytes[i]: i for i in model["vocab"].values() if len(self.bytes[i]) == 1} | {self.bytes[i]: i for i in made}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(made) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [x.ids for x in self.slow.encode_batch(texts, add_special_tokens=False)]
        return [self.slow.encode(x, add_special_tokens=False).ids if len(x) > LONG_RUN and _RUN.search(x) else self.fast.encode_ordinary(x) for x in texts]


class Pieces(dict):
    """A sentencepiece model file.

    Where no piece has a space mark behind another character, merges never reach over the beginning of a word with its marks; words are then
    encoded one by one and their pieces remembered. This holds only for texts that the model's normalizer leaves as they are but for the marks.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())
        across = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = not any(across.search(self.model.id_to_piece(i)) for i in range(len(self.bytes))) and self.model.encode("") == [] and self.model.normalize("a") == SPACE + "a"
        self.by_word = self.by_word and self.model.id_to_piece(self.model.piece_to_id(SPACE)) == SPACE

    def __missing__(self, word: str) -> list[int]:
        """The pieces of a word with its marks; the model adds the first mark."""
        found = self.model.encode(word[1:].replace(SPACE, " "), num_threads=1) if len(word) > 1 else [self.model.piece_to_id(SPACE)]
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        made = []
        for x in texts:
            marked = SPACE + x.replace(" ", SPACE)
            plain = self.by_word and self.model.normalize(x) == marked
            made.append(list(chain.from_iterable(map(self.__getitem__, _WORD.findall(marked)))) if plain else self.model.encode(x, num_threads=1))
        return made


_LOADED: dict = {}


def loaded(kind: type, data: bytes):
    """A worker reads each vocabulary once."""
    key = kind.__name__, hash(data)
    if key not in _LOADED:
        _LOADED[key] = kind(data)
        _LOADED[key].sizes = np.array([len(b) for b in _LOADED[key].bytes], np.int64)
    return _LOADED[key]


class Bits:
    """Marked positions as 64-bit words with a directory of the marks in front of each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-max(1, size) // 64) * 64, np.bool_)
        marks[positions] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """Marks up to and with each position."""
        word, bit = positions >> 6, (positions & 63).astype(np.uint64)
        low = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(low)

    def select(self) -> np.ndarray:
        """The positions of all marks, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def _flat(lists: list[list[int]]) -> Tokens:
    sizes = np.array([len(x) for x in lists], np.int64)
    return Tokens(np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes)


def align_texts(texts: list[str | None], a, b) -> dict[str, list]:
    """Of each text: token counts, groups, links, the spelled groups, and linked (pair, times), a pair being A id x 2^32 + B id."""
    rows, whole, token_a, token_b = [], [], [], []
    asked = [i for i, x in enumerate(texts) if x]
    spaced = [" " + texts[i] for i in asked]
    for i, x, ta, tb in zip(asked, spaced, a.encode(spaced), b.encode([texts[i] for i in asked]), strict=True):
        raw = x.encode()
        if b"".join(map(a.bytes.__getitem__, ta)) == raw == b"".join(map(b.bytes.__getitem__, tb)):
            rows.append(i)
            whole.append(len(raw))
            token_a.append(ta)
            token_b.append(tb)
    made = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups": [""] * len(texts), "pairs": [[]] * len(texts), "times": [[]] * len(texts)}
    if not rows:
        return made
    left, right, size = _flat(token_a), _flat(token_b), sum(whole)
    # The last byte of a token is its mark; texts follow each other, and the last byte of each is a shared cut.
    bits_a, bits_b = (Bits.of(np.cumsum(side.sizes[t.ids]) - 1, size) for side, t in ((a, left), (b, right)))
    cuts = (bits_a & bits_b).select()
    to_a, to_b = bits_a.rank(cuts), bits_b.rank(cuts)
    from_a, from_b = (np.concatenate(([0], x[:-1])) for x in (to_a, to_b))
    text_of = np.searchsorted(np.cumsum(whole), cuts, side="right")
    pair = (left.ids[to_a - 1] << 32) | right.ids[to_b - 1]

    # Tokens in the order in which they are spelled: those of a group's A side, then those of its B side.
    group_a, group_b = (np.repeat(np.arange(len(cuts)), z - s) for s, z in ((from_a, to_a), (from_b, to_b)))
    place_a, place_b = np.arange(len(left.ids)) + from_b[group_a], np.arange(len(right.ids)) + to_a[group_b]
    spelled = np.empty(len(left.ids) + len(right.ids), np.int64)
    spelled[place_a], spelled[place_b] = left.ids * 4, right.ids * 4
    spelled[place_a[to_a - 1]] += 1
    spelled[place_b[to_b - 1]] += 2
    words = _spellings(max(len(a.bytes), len(b.bytes)))

    last = np.searchsorted(text_of, np.arange(len(rows)), side="right")
    first = np.concatenate(([0], last[:-1]))
    for k, i in enumerate(rows):
        s, z = first[k], last[k]
        made["n_a"][i], made["n_b"][i] = len(token_a[k]), len(token_b[k])
        made["n_groups"][i] = made["n_links"][i] = int(z - s)
        made["groups"][i] = "".join(map(words.__getitem__, spelled[from_a[s] + from_b[s] : to_a[z - 1] + to_b[z - 1]].tolist()))[:-1]
        made["pairs"][i], made["times"][i] = np.unique(pair[s:z], return_counts=True)
    return made


_SPELLED: list[str] = []


def _spellings(n: int) -> list[str]:
    """At 4 x id + k: the id with what may follow it inside a side, after the A side, after the B side."""
    for i in range(len(_SPELLED) // 4, n):
        _SPELLED.extend((f"{i},", f"{i}|", f"{i};", ""))
    return _SPELLED


def _portions(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches with ROWS rows and about BYTES bytes of text at most."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(pc.fill_null(batch.column(at), "")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            used = ends[start - 1] if start else 0
            stop = min(start + ROWS, max(start + 1, int(np.searchsorted(ends, used + BYTES, side="right"))), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def align(docs: DataFrame, byte_level: str, piece_model: str, text_col: str = "text") -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, groups, pairs and times of every whole text.

    A is the byte-level BPE file byte_level on a space and the text, B the sentencepiece file piece_model on the text, to which it adds the space itself.
    groups spells the groups of tokens between shared cuts as `a1,a2|b1;a3|b2,b3`. pairs are the different linked pairs, A id x 2^32 + B id, and times how often each is linked. A text that is null or empty,
    or whose tokens of either side do not join to space and text byte by byte, has zeros, an empty string and empty lists. Rows are
    independent: repeated rows get equal results, an empty table stays empty, a long text is cut nowhere and is a portion of its own.
    Columns of docs that are called like a result, in any case of letters, are replaced, others stay.
    """
    names = without(docs, [m for m in _MADE if m != text_col.lower()])
    frame, at = docs.select(*[quoted(c) for c in names]), [c.lower() for c in names].index(text_col.lower())
    files = []
    for path in (byte_level, piece_model):
        with open(path, "rb") as f:
            files.append(f.read())
    shipped = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(ByteLevel, shipped.value[0]), loaded(Pieces, shipped.value[1])
        for batch in _portions(batches, at):
            made = align_texts(batch.column(at).to_pylist(), a, b)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[c], k) for c, k in zip(_MADE, kinds, strict=True))], [*names, *_MADE])

    kinds = [T.LongType()] * 4 + [T.StringType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())]
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *(T.StructField(c, k) for c, k in zip(_MADE, kinds, strict=True))]))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of all links of a batch."""
    pairs, times = batch.column("pairs"), batch.column("times")
    sizes = pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), sizes), pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by pair, summed within the task as far as HELD_PAIRS goes."""
    held_pairs, held_times, n = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate(held_pairs), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate(held_times), len(pairs)).astype(np.int64)

    for batch in batches:
        _, pairs, times = _columns(batch)
        held_pairs.append(pairs)
        held_times.append(times)
        n += len(pairs)
        if n >= HELD_PAIRS:
            pairs, times = summed()
            held_pairs, held_times, n = [pairs], [times], len(pairs)
            if n >= HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])
                held_pairs, held_times, n = [], [], 0
    if n:
        pairs, times = summed()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked pairs: n links have the pair, and best tells whether no A id has more with its B id. No links give no rows."""
    n = aligned.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = store(n, "align-counts")
    right = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = n.groupBy(right.alias("b")).agg(F.max("n").alias("most"))
    return n.withColumn("b", right).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _valued(pairs: np.ndarray, n: np.ndarray, best: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    row, own, times = _columns(batch)
    at = np.searchsorted(pairs, own)
    sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
    np.add.at(sums[0], row, times * best[at])
    np.add.at(sums[1], row, times * n[at])
    return sums[0], sums[1]


def value_links(aligned: DataFrame, counts: DataFrame, shipped_pairs: int = SHIPPED_PAIRS) -> DataFrame:
    """aligned without pairs and times, with n_best (links whose pair is best) and count_sum (the counts of all its links); both are 0 without links.

    aligned and counts are stored tables. Up to shipped_pairs pairs go to every task as two columns of numbers; where there are more, the links of all rows are joined with them.
    """
    kept = without(aligned, ["pairs", "times", "n_best", "count_sum"])
    spark = aligned.sparkSession
    if counts.count() <= shipped_pairs:
        table = counts.select("pair", "n", "best").toArrow().sort_by("pair")
        columns = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_best, total = _valued(*columns.value, batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best), pa.array(total)], [*kept, "n_best", "count_sum"])

        kinds = T.StructType([*aligned.select(*[quoted(c) for c in kept]).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        return aligned.mapInArrow(run, kinds)
    key = free_name(aligned, "align_row")
    rows = store(aligned.withColumn(key, F.monotonically_increasing_id()), "align-rows")
    links = rows.select(quoted(key).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    found = rows.join(sums, rows[key] == sums["row"], "left")
    return found.select(*[rows[c] for c in kept], F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))
