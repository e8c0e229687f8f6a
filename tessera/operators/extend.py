"""Embedders, extractors, scorers and normalisers of one's own, and chains in which the next takes what the one before could not do.

An extension is a name and a function that loads what it needs, a model say, and gives back a function from Arrow arrays to an Arrow array, null where it has no answer.
It is loaded once by each Python worker that needs it. A chain records for every row whose answer it got.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Run = Callable[..., pa.Array]


@dataclass(frozen=True)
class Extension:
    """What answers one kind of question. gives is the Spark type of an answer; rows is how many rows are handed over at once."""

    name: str
    load: Callable[[], Run]
    gives: str
    rows: int = 256
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


REGISTRY: dict[str, dict[str, Extension]] = {"embedder": {}, "extractor": {}, "scorer": {}, "normaliser": {}}
GIVES = {"embedder": "array<double>", "extractor": "array<string>", "scorer": "double", "normaliser": "string"}


def register(kind: str, name: str, load: Callable[[], Run], rows: int = 256) -> Extension:
    """Make an extension known under its kind; a name that is taken gets the new one."""
    REGISTRY[kind][name] = Extension(name, load, GIVES[kind], rows)
    return REGISTRY[kind][name]


_LOADED: dict = {}


def _ready(extension: Extension) -> Run | None:
    """Its function, loaded at most once by this worker; None if loading fails."""
    if extension.key not in _LOADED:
        try:
            _LOADED[extension.key] = extension.load()
        except Exception:  # noqa: BLE001  the next of the chain takes over
            _LOADED[extension.key] = None
    return _LOADED[extension.key]


def _answers(run: Run, columns: list[pa.Array], kind: pa.DataType) -> list:
    """Answers of some rows; where the function fails, halves of them are tried, so that a bad row costs only itself."""
    n = len(columns[0])
    try:
        made = run(*columns)
        if len(made) != n:
            raise ValueError("as many answers as rows are needed")
        return pa.array(made, kind).to_pylist() if not isinstance(made, pa.Array) else made.cast(kind).to_pylist()
    except Exception:  # noqa: BLE001
        if n == 1:
            return [None]
        half = n // 2
        return _answers(run, [c.slice(0, half) for c in columns], kind) + _answers(run, [c.slice(half) for c in columns], kind)


def answer(df: DataFrame, kind: str, chain: list[str | Extension], inputs: list[str], output: str) -> DataFrame:
    """df with output, the first answer along the chain that is not null, and output_by, the name of who gave it; both are null where nobody did.

    inputs are handed over as arrays, in this order, nulls included. A name that is not registered is a KeyError. Columns that are called like a result are replaced.
    """
    links = [REGISTRY[kind][c] if isinstance(c, str) else c for c in chain]
    names = [c for c in df.columns if c.lower() not in (output.lower(), f"{output}_by".lower()) or c in inputs]
    frame, at = df.select(*[df[c] for c in names]), [names.index(c) for c in inputs]
    gives = T._parse_datatype_string(GIVES[kind])
    arrow = to_arrow_type(gives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [None] * batch.num_rows
            by: list = [None] * batch.num_rows
            for link in links:
                left = [i for i, x in enumerate(by) if x is None]
                if not left or (ready := _ready(link)) is None:
                    continue
                for a in range(0, len(left), link.rows):
                    part = left[a : a + link.rows]
                    for i, x in zip(part, _answers(ready, [batch.column(c).take(pa.array(part)) for c in at], arrow), strict=True):
                        if x is not None:
                            found[i], by[i] = x, link.name
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow), pa.array(by, pa.string())], [*names, output, f"{output}_by"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(output, gives), T.StructField(f"{output}_by", T.StringType())]))


# ---- what is there from the start

DIM = 64


def _words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def _bucket(word: str, dim: int = DIM) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def _unit(buckets: list[int], dim: int = DIM) -> list[float] | None:
    """Counts by bucket as a unit vector, None without any."""
    counts = np.bincount(np.array(buckets, dtype=np.int64), minlength=dim).astype(float)
    return (counts / np.sqrt((counts * counts).sum())).tolist() if buckets else None


def _hashed() -> Run:
    known: dict[str, int] = {}
    of = lambda w: known[w] if w in known else known.setdefault(w, _bucket(w))
    return lambda texts: pa.array([_unit([of(w) for w in _words(t)]) for t in texts.to_pylist()], pa.list_(pa.float64()))


def letters(longest: int | None = None) -> Callable[[], Run]:
    """Hashed three-letter pieces of words; texts of more than `longest` words have no answer."""

    def load() -> Run:
        pieces = lambda w: [w[i : i + 3] for i in range(max(len(w) - 2, 1))]
        one = lambda ws: None if longest is not None and len(ws) > longest else _unit([_bucket(p) for w in ws for p in pieces(w)])
        return lambda texts: pa.array([one(_words(t)) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return load


def _frequent() -> Run:
    from tessera.functions.text import STOP_WORDS

    best = lambda t: [w for w, _ in sorted(Counter(w for w in _words(t) if len(w) > 2 and w not in STOP_WORDS).items(), key=lambda x: (-x[1], -len(x[0]), x[0]))[:10]] or None
    return lambda texts: pa.array([best(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def _capitals() -> Run:
    return lambda texts: pa.array([sorted({w.lower() for w in re.findall(r"(?<=[a-z,] )[A-Z][a-z]{2,}", t or "")}) or None for t in texts.to_pylist()], pa.list_(pa.string()))


def _token_f1() -> Run:
    def one(a: list[str], b: list[str]) -> float:
        same = sum((Counter(a) & Counter(b)).values())
        return 2.0 * same / (len(a) + len(b)) if same else 0.0

    return lambda left, right: pa.array([one(_words(a), _words(b)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def _contains() -> Run:
    """1 where the words of the second text hold those of the first in a row, else no answer."""
    held = lambda a, b: 1.0 if a and f" {' '.join(a)} " in f" {' '.join(b)} " else None
    return lambda left, right: pa.array([held(_words(a), _words(b)) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


register("embedder", "hashed", _hashed)
register("embedder", "letters", letters())
register("extractor", "frequent", _frequent)
register("extractor", "capitals", _capitals)
register("scorer", "token_f1", _token_f1)
register("scorer", "contains", _contains)
register("normaliser", "lower", lambda: lambda words: pa.array([None if w is None else w.lower() for w in words.to_pylist()], pa.string()))
register("normaliser", "plural", lambda: lambda words: pa.array([w.lower()[:-1] if w and len(w) > 3 and w.lower().endswith("s") and not w.lower().endswith("ss") else None for w in words.to_pylist()], pa.string()))
