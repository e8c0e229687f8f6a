"""Keyphrases of a text by position, spread and context of its words, without a trained model.

A word scores low, that is well, if it comes early, is often capitalised, frequent among the words of its text, and has few different neighbours; a phrase takes the scores of
its words. Of phrases that are nearly spelled alike only the best is kept. Texts are cut into sentences and fragments by Spark and dealt by id once; the words of a text are then counted
where it lies, in one pass, and near spellings are looked for only until enough phrases are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log
from statistics import fmean, median, pstdev
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Punctuation parts a sentence into fragments; phrases do not reach over it. Words of capitals only, words with a capital first, words with a letter.
PUNCTUATION, CAPITALS, CAPITAL, LETTER = r"[^\p{L}\p{N}_ \t\r\n\f]+", r"^\p{Lu}{2,}$", r"^\p{Lu}", r"\p{L}"
SHORT = 2
#: Between sentences and between fragments, once texts are cut; texts of a batch.
SENTENCE, FRAGMENT, TEXTS = "\x01", "\x02", 1024
_STOP = set(X.STOP_WORDS)


def plain(word: str) -> bool:
    """Whether a word can be a keyword: longer than SHORT, with a letter, and no stop word."""
    return len(word) > SHORT and word not in _STOP and any(c.isalpha() for c in word)


def edits(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as bits of a number."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        same = at.get(c, 0)
        flat, steep = (((same & up) + up) ^ up) | same, same | down
        more, less = down | ~(flat | up) & full, up & flat
        found += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(steep | more)) & full, more & steep & full
    return found


def word_scores(texts: list[tuple[str, str]]) -> tuple[dict[str, tuple[int, float]], Counter]:
    """Of one text, given as rows of its words, cut, and the same in lower case: (count, score) of each word that can be a keyword, low being good, and the counts of pairs of such words."""
    places: dict[str, list[int]] = {}
    lefts: dict[str, list[str]] = {}
    rights: dict[str, list[str]] = {}
    upper, title, pairs, last = Counter(), Counter(), Counter(), 0
    for raw_text, low_text in texts:
        for n, (raw_sentence, low_sentence) in enumerate(zip(raw_text.split(SENTENCE), low_text.split(SENTENCE), strict=True)):
            for k, (raws, lows) in enumerate(zip(raw_sentence.split(FRAGMENT), low_sentence.split(FRAGMENT), strict=True)):
                raws, lows, left = raws.split(), lows.split(), None
                for i, (raw, low) in enumerate(zip(raws, lows, strict=True)):
                    last = n if n > last else last
                    places.setdefault(low, []).append(n)
                    if left is not None:
                        lefts.setdefault(low, []).append(left)
                        rights.setdefault(left, []).append(low)
                    if raw != low and category(raw[0]) == "Lu":
                        if len(raw) > 1 and all(category(c) == "Lu" for c in raw):
                            upper[low] += 1
                        elif k or i:
                            title[low] += 1
                    left = low
    can = [w for w in places if plain(w)]
    if not can:
        return {}, pairs
    counts = [len(places[w]) for w in can]
    usual, most, scores = fmean(counts) + pstdev(counts), max(map(len, places.values())), {}
    for w, tf in zip(can, counts, strict=True):
        near = sum(len(set(side[w])) / len(side[w]) for side in (lefts, rights) if w in side)
        context = 1 + near * tf / most
        case = max(upper[w], title[w]) / (1 + log(tf))
        scores[w] = tf, context * log(log(3 + median(places[w]))) / (case + tf / usual / context + len(set(places[w])) / (last + 1) / context)
    for w in can:
        pairs.update((w, r) for r in rights.get(w, ()) if r in scores)
    return scores, pairs


def phrases(texts: list[tuple[str, str]], top: int, most_alike: float) -> list[tuple[float, str]]:
    """(score, keyword): the `top` best words and pairs of a text, best first, none more than most_alike alike with a better one."""
    scores, pairs = word_scores(texts)
    found = [(s / (tf * (1 + s)), w) for w, (tf, s) in scores.items()]
    for (w, r), n in pairs.items():
        a, b = scores[w][1], scores[r][1]
        found.append((a * b / (n * (1 + a + b)), f"{w} {r}"))
    kept: list[tuple[float, str, set[str]]] = []
    for s, k in sorted((floor(s * 1e8 + 0.5) / 1e8, k) for s, k in found):
        letters = set(k)
        for _, other, theirs in kept:
            longest = max(len(k), len(other))
            # Each letter that only one of them has takes an edit.
            if 1 - max(len(letters - theirs), len(theirs - letters), abs(len(k) - len(other))) / longest > most_alike and 1 - edits(k, other) / longest > most_alike:
                break
        else:
            kept.append((s, k, letters))
            if len(kept) == top:
                break
    return [(s, k) for s, k, _ in kept]


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 10, most_alike: float = 0.7) -> DataFrame:
    """(id, rank, keyword, score): the `top` best words and pairs of adjacent words of each text, best first.

    A phrase scores as the product of its words' scores over its count times 1 + their sum. From the best on, a phrase is left out if one already kept is more than most_alike alike;
    equal scores, to 8 digits, go by alphabet. Null and empty texts have none. Rows of one id are one text; null ids are one too.
    """
    # Texts are dealt by id once; rows of one id lie beside each other then.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_col, text_col).repartition(parts, id_col).sortWithinPartitions(id_col)
    cut = F.array_join(F.transform(X.sentences(F.col(text_col)), lambda s: F.regexp_replace(s, PUNCTUATION, FRAGMENT)), SENTENCE)
    rows = rows.select(id_col, cut.alias("_cut")).select(id_col, "_cut", F.lower("_cut").alias("_low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts, done, made = None, [], [], False
        kind = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int32(), pa.string(), pa.float64()), strict=True)], [id_col, "rank", "keyword", "score"])

        for whole in batches:
            kind = whole.schema[0].type
            for key, *text in zip(*(whole.column(i).to_pylist() for i in range(3)), strict=True):
                if made and key != own:
                    done += [(own, n, k, s) for n, (s, k) in enumerate(phrases(texts, top, most_alike), 1)]
                    texts = []
                own, made = key, True
                texts.append(tuple(text))
                if len(done) >= TEXTS * top:
                    yield batch()
                    done.clear()
        if made:
            done += [(own, n, k, s) for n, (s, k) in enumerate(phrases(texts, top, most_alike), 1)]
            yield batch()

    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, rank int, keyword string, score double")
