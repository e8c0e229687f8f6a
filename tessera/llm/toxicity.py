"""Toxicity scores from a weighted lexicon.

Folding. Letters are lower-cased, look-alike letters of other scripts and full-width forms become the letter they
imitate, digits and signs that stand for letters become those letters, invisible characters go, and letters that are set apart one by one are put together.
Words are runs of letters of the folded text.

Lexicon. Entries are whole words, or beginnings of words where no single word has nearly all of a beginning's texts (a stem with many endings). They are learned from a
bounded sample of labelled texts: one enters if toxic texts hold it in sufficient number and clean texts hardly do, and its weight is its log-odds.
A whole word also counts with a plural s or es. Words that begin like an entry and are at home in clean texts become exceptions, and so do
pairs of an entry and a neighbouring word that are, beside given phrases.

Score. An Aho-Corasick automaton finds entries and exceptions in one pass; an entry counts at the start of a word and outside
exceptions. The summed weight is set against the number of words, and a two-parameter logistic curve, fitted to the
sample, turns the total and the density into a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pieces, quoted, without

#: Characters and the letters they stand for (Cyrillic, then Greek look-alikes, then digits and signs).
LOOKALIKES = dict(zip("аеорсухівкмнтјѕԁԛԝһӏ" + "αβεικνορτυχ" + "0123456789@$€£|+", "aeopcyxibkmhtjsdqwhl" + "abeiknoptux" + "oizeasgtbgaselit", strict=True))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_TABLE = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE))
_WORD = re.compile(r"[^\W\d_]+")
#: An exclamation mark before a letter stands for i. Four letters or more with the same sign between each two are one word.
_BANG, _APART = re.compile(r"!(?=[^\W\d_])"), re.compile(r"(?<![^\W\d_])[^\W\d_]([ .\-_*])[^\W\d_](?:\1[^\W\d_]){2,}(?![^\W\d_])")
_SIGNS = re.compile(r"[ .\-_*]")
PREFIXES = range(4, 13)
#: A longer piece stands for a shorter one if it has this share of its toxic texts.
STANDS = 0.9


def fold(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "!" in text:
        text = _BANG.sub("i", text)
    return _APART.sub(lambda m: _SIGNS.sub("", m[0]), text.translate(_TABLE))


@dataclass
class Lexicon:
    """weights by folded beginning of a word, or by whole word where the key ends in a blank; exceptions are folded words or phrases; bias, total and density: of the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    total: float = 1.0
    density: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        """Values: length, weight as a beginning, weight as a whole word, whether it is an exception."""
        cells: dict[str, list] = {}
        for key, weight in self.weights.items():
            word = key.rstrip()
            cell = cells.setdefault(word, [len(word), 0.0, 0.0, False])
            cell[2 if key.endswith(" ") else 1] = weight
        for word in self.exceptions:
            cells.setdefault(word, [len(word), 0.0, 0.0, False])[3] = True
        if not cells:
            return None
        made = ahocorasick.Automaton()
        for word, cell in cells.items():
            made.add_word(word, tuple(cell))
        made.make_automaton()
        return made


def _ends(folded: str, at: int) -> bool:
    """Whether no word goes on at this place."""
    return at >= len(folded) or not folded[at].isalpha()


def matches(folded: str, automaton: ahocorasick.Automaton | None) -> float:
    """Summed weight of the entries that count in a folded text; of entries that begin together the heaviest counts."""
    if automaton is None:
        return 0.0
    starts: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for last, (length, beginning, word, exception) in automaton.iter(folded):
        start, end = last - length + 1, last + 1
        if start and folded[start - 1].isalpha():
            continue
        whole = _ends(folded, end)
        if exception and whole:
            free.append((start, end))
            continue
        if word > beginning and (whole or any(folded.startswith(s, end) and _ends(folded, end + len(s)) for s in ("s", "es"))):
            beginning = word
        if beginning:
            starts[start] = max(starts.get(start, 0.0), beginning)
    return sum(w for s, w in starts.items() if not any(a <= s < b for a, b in free))


def features(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """log(1 + weight) and log(1 + weight per hundred words)."""
    folded = fold(text)
    weight = matches(folded, automaton)
    return (float(np.log1p(weight)), float(np.log1p(100.0 * weight / (1 + folded.count(" "))))) if weight else (0.0, 0.0)


def _counted(pieces_of):
    """For each piece the number of toxic and of clean texts in these batches that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[not label].update(pieces_of(_WORD.findall(fold(text or ""))))
        keys = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], ["piece", "toxic", "clean"])

    return run


def _beginnings(words: list[str]) -> set[str]:
    """All beginnings of words, and the words themselves with a blank."""
    return {w[:n] for w in set(words) for n in PREFIXES if len(w) >= n} | {w + " " for w in words}


def _neighbours(weights: dict[str, float]):
    """Pairs of an entry and the word before or behind it."""
    whole, begins = {w.rstrip() for w in weights if w.endswith(" ")}, tuple(w for w in weights if not w.endswith(" "))

    def pairs(words: list[str]) -> set[str]:
        at = [i for i, w in enumerate(words) if w in whole or (begins and w.startswith(begins))]
        return {" ".join(words[j : j + 2]) for i in at for j in (i - 1, i) if 0 <= j < len(words) - 1}

    return pairs


def _chosen(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of pieces(toxic texts, odds) that begin alike: a longer one in place of a shorter one if it has nearly all of its texts; else the shorter one for all of them."""
    by_length = sorted(found, key=lambda p: (len(p), p))
    longest = {p: max((found[q][0] for q in by_length if len(q) > len(p) and q.startswith(p)), default=0) for p in by_length}
    kept: dict[str, float] = {}
    for p in by_length:
        if longest[p] < STANDS * found[p][0] and not any(p.startswith(k) for k in kept):
            kept[p] = found[p][1]
    return kept


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, support: float = 0.015, least_odds: float = 3.5, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon of docs with labels(id_col, label).

    At most sample_rows labelled ids are used, those with the smallest hashes; they alone are joined with the texts, and repeated texts count once. An
    entry needs a share `support` of the toxic texts (5 at least) and log-odds of least_odds. Exception phrases are learned, words and pairs of words with an entry that are at home in clean texts; `exceptions` adds known ones. Rows without label are left out; of contradicting labels
    the larger counts. Without toxic rows the lexicon is empty and all scores are the same low value.
    """
    known = labels.where(F.col("label").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col("label").cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), id_col)
    rows = rows.groupBy("text").agg(F.max("label").alias("label")).persist()
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        rows.unpersist()
        return Lexicon(exceptions=[fold(x) for x in exceptions])
    kind, tasks = "piece string, toxic long, clean long", docs.sparkSession.sparkContext.defaultParallelism
    counts = rows.repartition(tasks).mapInArrow(_counted(_beginnings), kind).groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # At most 1 / support pieces of each toxic text can pass, so what comes to the driver is bounded by the sample.
    found = counts.where((F.col("toxic") >= max(5.0, support * toxic)) & (odds >= least_odds)).select("piece", "toxic", odds.alias("odds")).collect()
    weights = _chosen({r.piece: (r.toxic, float(r.odds)) for r in found})
    at_home = []
    if weights:
        begins = F.lit(False)
        for w in sorted(weights):
            begins = begins | F.col("piece").startswith(w.rstrip())
        clean_home = (F.col("clean") >= 2) & (F.col("clean") * toxic > F.col("toxic") * clean)
        at_home = [r.piece.strip() for r in counts.where(begins & F.col("piece").endswith(" ") & clean_home).select("piece").collect()]
        phrases = rows.repartition(tasks).mapInArrow(_counted(_neighbours(weights)), kind).groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        at_home += [r.piece for r in phrases.where(clean_home).select("piece").collect()]
    lexicon = Lexicon(weights, sorted({fold(x) for x in exceptions} | set(at_home)))
    seen = rows.repartition(tasks).mapInArrow(_features(lexicon), "total double, density double, label int").collect()
    rows.unpersist()
    _fit(lexicon, np.array([[1.0, r.total, r.density] for r in seen]), np.array([r.label for r in seen], dtype=float))
    return lexicon


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [features(t or "", automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column("label")], ["total", "density", "label"])

    return run


def _fit(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> None:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * len(y) / 100 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * len(y) / 100 * w)
    lexicon.bias, lexicon.total, lexicon.density = (float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text.

    A null text counts as empty; a text without matches gets the curve's lowest value; long texts are folded and searched whole. Repeated rows and
    equal texts get equal scores; an empty table stays empty. A column of docs that is called like the result, in any case of letters, is replaced.
    """
    kept = without(docs, [out])
    text_at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in pieces(batches):
            found = np.array([features(t.as_py() or "", automaton) for t in batch.column(text_at)], dtype=float).reshape(-1, 2)
            z = lexicon.bias + found @ np.array([lexicon.total, lexicon.density])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], [*kept, out])

    frame = docs.select(*[quoted(c) for c in kept])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))
