"""Constants that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """They must be these for results to agree with the engine that this one stands in for."""

    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 5
    prefetch_k: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    entity_cap: int = 15
    community_min_size: int = 3
    attempts: int = 3
    token_budget: int = 400_000
    token_reserve: int = 60_000
    tokens_first: int = 16_384
    tokens_cap: int = 40_000
    artifact_max_bytes: int = 5_000_000
    heading_slack: int = 40
    label_window: int = 160
    figure_tolerance: float = 0.005
    provenance_minimum: float = 0.85
    note_min_chars: int = 80
    document_min_chars: int = 100
    heading_ratio: float = 1.15


SETTINGS = Settings()
