"""The graph of one question: its candidates, those of the turns before, their concepts, and the distance of every candidate from what the question names.

A question's graph has the pools of its session up to its turn, so it is bounded by turns x pool and is walked inside one group; groups are independent
and spread over the executors. Edges: chunk and concept (0.3, less for concepts whose word is near its chunks), chunks with two common concepts or
more, chunks of high cosine; the smaller weight wins. Walks use the edges up to a percentile of all weights.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators.vectors import DIM

SPEC = "doc_id long, gated boolean, added boolean, semantic_score double, distance double"


def bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % DIM


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=-1, keepdims=True)) + 1e-8)


def _letters(word: str) -> np.ndarray:
    made = np.zeros(DIM)
    for i in range(max(len(word) - 2, 1)):
        made[bucket(word[i : i + 3])] += 1
    return made / np.sqrt((made * made).sum())


def edges_of(ids: list, concepts: list[list[tuple[str, str]]], vectors: np.ndarray, settings: Settings) -> dict[tuple, float]:
    """Weights by pair of nodes, each pair once; a node is a document's id or a concept (type, word)."""
    made: dict[tuple, float] = {}
    holders: dict[tuple[str, str], list[int]] = {}
    for i, listed in enumerate(concepts):
        for c in listed:
            holders.setdefault(c, []).append(i)
    for (kind, word), own in holders.items():
        near = float(vectors[own, bucket(word)].mean())
        weight = settings.concept_weight * (1 - 0.5 * near) if near > 0.3 else settings.concept_weight
        made.update({(ids[i], (kind, word)): round(weight, 6) for i in own})
    cosines = np.round(vectors @ vectors.T, 6)
    sets = [set(x) for x in concepts]
    for i in range(len(ids)):
        for j in range(i):
            common, weights = len(sets[i] & sets[j]), []
            if common >= 2:
                weights.append(round(max(0.1, 1.0 / (1 + common)), 6))
            if cosines[i, j] > settings.similarity_edge:
                weights.append(round(max(0.0, 1 - cosines[i, j]), 6))
            if weights:
                made[ids[i], ids[j]] = min(weights)
    return made


def matched(words: list[str], nodes: set[tuple[str, str]], least: float) -> set[tuple[str, str]]:
    """Keywords that the question names; for each of its words that is none, the concept of the most similar word from `least` on, ties by type and word."""
    found = {("KEYWORD", w) for w in words} & nodes
    rest = [w for w in words if ("KEYWORD", w) not in nodes]
    if rest and nodes:
        order = sorted(nodes)
        near = np.round(np.array([_letters(w) for w in rest]) @ np.array([_letters(w) for _, w in order]).T, 6)
        found |= {order[int(row.argmax())] for row in near if row.max() >= least}
    return found


def distances(links: dict, sources: set, cutoff: float) -> dict:
    """Shortest distances up to the cutoff from any source."""
    best, queue = dict.fromkeys(sources, 0.0), [(0.0, n, s) for n, s in enumerate(sorted(sources))]
    tick = len(queue)
    while queue:
        d, _, node = heapq.heappop(queue)
        if d > best[node]:
            continue
        for other, w in links.get(node, ()):
            if d + w <= cutoff and d + w < best.get(other, np.inf):
                best[other] = d + w
                heapq.heappush(queue, (d + w, tick, other))
                tick += 1
    return best


def ranks(links: dict, sources: set, rounds: int, damping: float) -> dict:
    """Personalised PageRank over the sources, edge weights as they are; what dead ends hold goes back to the sources."""
    base = 1.0 / len(sources)
    rank = dict.fromkeys(sources, base)
    total = {n: sum(w for _, w in out) for n, out in links.items()}
    for _ in range(rounds):
        step = dict.fromkeys(sources, 0.0)
        lost = 0.0
        for node, p in rank.items():
            if total.get(node, 0.0) <= 0:
                lost += p
                continue
            for other, w in links[node]:
                if w > 0:
                    step[other] = step.get(other, 0.0) + damping * p * w / total[node]
        for s in sources:
            step[s] += base * (1 - damping + damping * lost)
        rank = step
    return rank


def walk(group: pd.DataFrame, settings: Settings) -> list[tuple]:
    """(id, gated, added, semantic_score, distance) of one question, with and without the gate on added neighbours; distance is None where the question names no concept."""
    group = group.sort_values("doc_id")
    ids, seed = group["doc_id"].tolist(), group["seed"].tolist()
    concepts = [[] if c is None else [(x["type"], x["word"]) for x in c] for c in group["concepts"]]
    vectors = _unit(np.array(group["embedding"].tolist(), dtype=float))
    semantic = dict(zip(ids, np.round(vectors @ _unit(np.array(group["q"].iloc[0], dtype=float)), 6).tolist(), strict=True))
    edges = edges_of(ids, concepts, vectors, settings)
    links: dict = {}
    if edges:
        cut = round(float(np.quantile(np.array(list(edges.values()) * 2), min(1.0, max(0.1, settings.edge_top_p)))), 9)
        for (a, b), w in edges.items():
            if w <= cut:
                links.setdefault(a, []).append((b, w))
                links.setdefault(b, []).append((a, w))
    seeds = {i for i, s in zip(ids, seed, strict=True) if s}
    near: dict = {}
    for s in seeds:
        for other, w in links.get(s, ()):
            if not isinstance(other, tuple) and other not in seeds and w <= 0.5:
                near[other] = min(w, near.get(other, np.inf))
    neighbours = sorted(near, key=lambda i: (round(near[i], 8), i))[: settings.expansion_n]
    best = max((0.0 if pd.isna(x) else x for x, s in zip(group["similarity_score"], seed, strict=True) if s), default=0.3)
    sources = matched(list(group["words"].iloc[0]), {c for listed in concepts for c in listed}, settings.fuzzy_concept)
    reach = distances(links, sources, settings.distance_cutoff)
    rank = ranks(links, sources, settings.rank_rounds, settings.damping) if sources else {}
    out = []
    for gated in (True, False):
        added = [i for i in neighbours if not gated or semantic[i] >= max(0.1, 0.4 * best)]
        every = [i for i in ids if i in seeds] + added
        known = [reach[i] for i in every if i in reach]
        low, high = (min(known), max(known)) if known else (0.0, 0.0)
        top = max((rank.get(i, 0.0) for i in every), default=0.0)
        for i in every:
            # Rounded, so that the order in which ranks are added up does not show.
            scaled = 0.8 if i not in reach else round((reach[i] - low) / (high - low), 9) if high > low else 0.0
            share = round(rank.get(i, 0.0) / top, 9) if top > 0 else 0.0
            out.append((i, gated, i not in seeds, semantic[i], round(0.7 * scaled + 0.3 * (1 - share), 9) if sources else None))
    return out


def question_distances(pools: DataFrame, turns: DataFrame, concepts: DataFrame, vectors: DataFrame, settings: Settings, part: str = "item_id", asked: DataFrame | None = None) -> DataFrame:
    """(part, doc_id, gated, added, semantic_score, distance) of every candidate of every question, for both positions of the gate.

    pools(part, doc_id, similarity_score); turns(part, session, turn, words, q); concepts(doc_id, word, type); vectors(doc_id, embedding). Neighbours that earlier turns
    brought into the graph are added to the pool, the nearest first. asked(part), if given, has the questions that are wanted; the others only have pools.
    """
    own = pools.join(turns.select(part, "session", F.col("turn").alias("_at")), part).select("session", "_at", "doc_id")
    wanted = turns if asked is None else turns.join(asked.select(part).distinct(), part, "left_semi")
    rows = wanted.select(part, "session", "turn").join(own, "session").where("_at <= turn").groupBy(part, "doc_id").agg(F.max(F.col("_at") == F.col("turn")).alias("seed"))
    listed = concepts.groupBy("doc_id").agg(F.collect_list(F.struct("type", "word")).alias("concepts"))
    rows = rows.join(pools.select(part, "doc_id", "similarity_score"), [part, "doc_id"], "left").join(listed, "doc_id", "left").join(vectors, "doc_id").join(turns.select(part, "words", "q"), part)
    kind = dict(turns.dtypes)[part]
    names = [part, "doc_id", "gated", "added", "semantic_score", "distance"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame([(group[part].iloc[0], *r) for r in walk(group, settings)], columns=names)
        return made.astype({"distance": "float64"})

    return rows.groupBy(part).applyInPandas(run, f"{part} {kind}, {SPEC}")
