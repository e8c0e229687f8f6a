"""Settings of the engine, presets, and the switches of the four retrieval modes."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """The defaults of retrieval, scoring, graph and chunking."""

    max_chunk_words: int = 512
    n_chunks: int = 5
    pool_multiplier: int = 3
    pool_minimum: int = 20
    bm25_weight: float = 0.4
    rrf_k: int = 30
    alpha: float = 0.7
    beta: float = 0.3
    factual_weights: tuple[float, float] = (0.85, 0.15)
    complex_weights: tuple[float, float] = (0.40, 0.60)
    low_semantic: float = 0.40
    anchor_threshold: float = 0.70
    anchor_floor: float = 0.80
    boost_step: float = 0.03
    boost_cap: float = 0.15
    boost_least_hits: int = 2
    warn_semantic: float = 0.3
    min_similarity: float = 0.15
    min_return: int = 5
    rerank_n: int = 20
    rerank_weight: float = 0.5
    adaptive_ratio: float = 0.3
    adaptive_gap: float = 0.5
    adaptive_keep: int = 5
    edge_top_p: float = 0.55
    distance_cutoff: float = 4.0
    similarity_edge: float = 0.65
    concept_weight: float = 0.3
    fuzzy_concept: float = 0.55
    unreachable: float = 999.0
    damping: float = 0.85
    rank_rounds: int = 20
    expansion_n: int = 5
    context_window: int = 8192
    target_latency_ms: float = 200.0
    target_vram_gb: float = 7.5
    target_coverage: float = 0.8


@dataclass(frozen=True)
class ModeSpec:
    """What a retrieval mode switches on."""

    name: str
    graph: bool
    bm25_weight: float
    soft_filter: bool = False
    adaptive: bool = False
    gate: bool = False
    rerank: bool = False
    dynamic_weights: bool = False
    anchor: bool = False
    boost: bool = False
    save_graph: bool = False


def modes(settings: Settings | None = None) -> dict[str, ModeSpec]:
    """The four modes of the ablation; hybrid_rag uses 0.4 where the configured lexical weight is 0."""
    w = (settings or Settings()).bm25_weight
    found = [
        ModeSpec("baseline", False, 0.0),
        ModeSpec("hybrid_rag", False, w or 0.4),
        ModeSpec("graph_nofilter", True, w, save_graph=True),
        ModeSpec("full", True, w, True, True, True, True, True, True, True, True),
    ]
    return {m.name: m for m in found}


PRESETS = {
    "default": Settings(),
    "stress": replace(Settings(), context_window=4096, max_chunk_words=256, edge_top_p=0.5, rerank_n=8, rerank_weight=0.35, bm25_weight=0.35, rrf_k=40, min_return=3, min_similarity=0.2),
    "optimum": replace(Settings(), max_chunk_words=384, rerank_n=12, rerank_weight=0.45),
    "max": replace(Settings(), context_window=16384, max_chunk_words=768, edge_top_p=0.65, rerank_n=24, min_return=6, min_similarity=0.12),
}


#: Keys of nested settings files, by section, and the settings that they stand for.
SECTIONS = {
    "rag": {"top_k": "n_chunks"}, "chunking": {"max_chunk_size": "max_chunk_words"}, "graph": {"alpha": "alpha", "beta": "beta", "edge_top_p": "edge_top_p"},
    "reranker": {"cross_encoder_top_n": "rerank_n", "cross_encoder_weight": "rerank_weight"}, "vllm": {"max_model_len": "context_window"},
    "retrieval": {
        "initial_top_k_multiplier": "pool_multiplier", "min_similarity_score": "min_similarity", "bm25_weight": "bm25_weight", "rrf_k": "rrf_k", "semantic_anchor_threshold": "anchor_threshold", "min_return_chunks": "min_return",
        "low_semantic_warning_threshold": "warn_semantic",
    },
}


def flat(found: dict) -> dict:
    """Settings by name: those of sections under the names they have here, and what is named so already."""
    made = {k: v for k, v in found.items() if not isinstance(v, dict)}
    for section, names in SECTIONS.items():
        inner = found.get(section)
        made |= {names[k]: v for k, v in inner.items() if k in names and v is not None} if isinstance(inner, dict) else {}
    return made


def load_settings(path: str | None = None, variable: str = "TESSERA_CONFIG_PATH") -> Settings:
    """Settings from a JSON object of field names, or of sections; an unset, missing or malformed file means the defaults, unknown keys are ignored."""
    path = path or os.environ.get(variable)
    try:
        with open(path) as f:
            found = flat(json.load(f))
        known = {f.name for f in fields(Settings)}
        return replace(Settings(), **{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known})
    except (AttributeError, OSError, TypeError, ValueError):
        return Settings()
