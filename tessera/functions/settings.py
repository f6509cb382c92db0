"""Settings of an engine, checked when they are made, and references to environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

MODES = ("vector", "graph", "pagerank", "hybrid")


def resolve(value: str) -> str:
    """``os.environ/NAME`` and ``#NAME`` stand for a variable, which must be set; other strings for themselves."""
    for mark in ("os.environ/", "#"):
        if value.startswith(mark):
            name = value.removeprefix(mark)
            if name not in os.environ:
                raise KeyError(f"environment variable {name} is not set")
            return os.environ[name]
    return value


@dataclass(frozen=True)
class Settings:
    chunk_kind: str = "recursive"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    dim: int = 64
    top_k: int = 4
    search_kind: str = "similarity"
    index: str = "none"  # of vectors: eager (built after each ingest), lazy (built by the first search that lacks it) or none (only what build_index makes)
    least_relevance: float = 0.5
    seed_strategy: str = "vector"
    fallback: bool = True
    max_hops: int = 2
    seeds: int = 5
    min_score: float = 0.0
    max_nodes: int = 200  # of a question's neighbourhood; 0: the whole graph, by forward push
    least_pushed: float = 1e-4
    alpha: float = 0.15
    iterations: int = 50
    tolerance: float = 1e-6
    hybrid_mode: str = "concat"
    vector_weight: float = 0.6
    graph_weight: float = 0.4
    context_chars: int = 8000

    def __post_init__(self) -> None:
        for f in fields(self):
            kind, value = type(f.default), getattr(self, f.name)
            value = resolve(value) if isinstance(value, str) else value
            object.__setattr__(self, f.name, value.lower() in ("1", "true", "yes") if kind is bool and isinstance(value, str) else kind(value))
        if not 0 < self.alpha < 1 or self.top_k < 1 or self.max_hops < 0 or self.chunk_size < 1:
            raise ValueError("alpha must be between 0 and 1, top_k and chunk_size positive, max_hops not negative")
        if self.seed_strategy not in ("vector", "fuzzy"):
            raise ValueError("seed_strategy is vector or fuzzy")
        if self.index not in ("none", "lazy", "eager"):
            raise ValueError("index is none, lazy or eager")

    @classmethod
    def of(cls, given: Mapping[str, Any]) -> Settings:
        """Numbers may be strings, as some files give them; unknown names raise."""
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)
