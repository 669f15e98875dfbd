"""Every tunable of the engine in one place; operators take these as defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Fusion constant and channel weights (vector, lexical, graph).
    rrf_k: int = 60
    memory_weights: tuple[float, float, float] = (0.40, 0.15, 0.45)
    code_weights: tuple[float, float, float] = (0.50, 0.20, 0.30)
    # BM25.
    k1: float = 1.2
    b: float = 0.75
    empty_avgdl: float = 256.0
    # Half-lives in days by memory type, floor of the decay, reinforcement.
    half_life_episodic: float = 30.0
    half_life_semantic: float = 180.0
    half_life_procedural: float = 365.0
    decay_floor: float = 0.05
    access_damping: float = 0.5
    reinforcement: float = 0.5
    reinforcement_cap: float = 3.0
    # Personalised PageRank.
    ppr_damping: float = 0.5
    ppr_tolerance: float = 1e-6
    ppr_iterations: int = 15
    # Traversal limits.
    bfs_max_depth: int = 5
    bfs_per_level: int = 100
    bfs_total: int = 1000
    touching_limit: int = 500
    # Paging.
    default_limit: int = 20
    max_limit: int = 100
    #: Broadcast a side only when its counted rows are below this.
    broadcast_rows: int = 200_000


CONFIG = Config()


def normalize_limit(limit: int | None) -> int:
    """Default 20, between 1 and 100."""
    return max(1, min(CONFIG.max_limit, CONFIG.default_limit if limit is None else limit))


def overfetch(limit: int, filtered: bool) -> int:
    """Rows fetched from each channel of a memory search before fusion."""
    return limit * (5 if filtered else 3)


def code_overfetch(limit: int, filtered: bool, fast: bool) -> int:
    """Rows fetched from each channel of a code search before fusion."""
    return limit if fast else min(limit * 10, 300) if filtered else min(limit * 8, 250)
