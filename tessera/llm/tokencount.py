"""Token counts of a unigram tokenizer without making the tokens.

A text is split at white space (runs of any length and kind are one split, as by a tokenizer's white-space splitter) and each word gets the
word mark in front; a word that holds the mark itself is cut before it. Aho-Corasick lists all vocabulary
pieces that end at each character; dynamic programming carries the best score and the number of pieces of the best way to
get there. Ties go to the piece that starts first, as in the tokenizer's own Viterbi search, which replaces a way
only by a strictly better one. A character that is no piece costs UNKNOWN less than the
worst piece, and adjacent unknown characters are one token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import pieces, quoted, without

#: The word mark and the penalty of an unknown character.
MARK, UNKNOWN = "▁", 10.0
#: Words whose counts a task remembers, none of them longer than so many letters.
REMEMBERED, LONG_WORD = 400_000, 64
#: Python counts these among white space; the property White_Space does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARKED = re.compile(f"{MARK}?[^{MARK}]+|{MARK}")


def split_words(text: str) -> list[str]:
    """Runs of characters without the property White_Space."""
    if _SEPARATORS.search(text) is None:
        return text.split()
    return re.findall("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text)


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file, with log-probabilities that fall with the rank as in Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [p for _, p in sorted((-model.get_score(i), model.id_to_piece(i)) for i in ids)]
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return [(p, -math.log(r + 2) - total) for r, p in enumerate(pieces)]


class Counter(dict):
    """Pieces by word, counted when first asked for; unknown tokens are counted in the upper half of the number."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = sum(self._count(p if p[0] == MARK else MARK + p) for p in _MARKED.findall(word)) if MARK in word else self._count(MARK + word)
        if len(word) <= LONG_WORD:
            self[word] = found
        return found

    def _count(self, text: str) -> int:
        n = len(text)
        best, count, unknown = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0], done = 0.0, 0
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            if end - 1 > done:
                self._unknowns(done, end - 1, best, count, unknown)
                done = end - 1
            start = end - length
            if best[start] > -math.inf and best[start] + score > best[end]:
                best[end], count[end], unknown[end] = best[start] + score, count[start] + 1, False
            if length == 1:
                done = end
        self._unknowns(done, n, best, count, unknown)
        return count[n]

    def _unknowns(self, begin: int, end: int, best: list[float], count: list[int], unknown: list[bool]) -> None:
        """Ways over single characters that are no pieces, into the positions begin + 1 to end."""
        for at in range(begin + 1, end + 1):
            way = best[at - 1] + self.unknown
            if way > best[at]:
                best[at], count[at], unknown[at] = way, count[at - 1] + (0 if unknown[at - 1] else 1 + (1 << 32)), True


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text") -> DataFrame:
    """docs with n_words, n_tokens and n_unknown of every whole text.

    Null and empty texts, and those of white space only, have no tokens. Repeated rows have equal counts; an empty table
    stays empty; a long word is searched in one piece. Columns of docs that are called like a result, in any case of letters, are replaced.
    """
    made = ["n_words", "n_tokens", "n_unknown"]
    names = without(docs, made)
    frame, at = docs.select(*[quoted(c) for c in names]), names.index(text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value)
        for batch in pieces(batches):
            words, totals = [], []
            for text in batch.column(at):
                found = split_words(text.as_py() or "")
                words.append(len(found))
                totals.append(sum(map(counter.__getitem__, found)))
            counts = [pa.array(words, pa.int64()), pa.array([t & 0xFFFFFFFF for t in totals], pa.int64()), pa.array([t >> 32 for t in totals], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], [*names, *made])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *(T.StructField(name, T.LongType()) for name in made)]))
