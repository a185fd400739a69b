"""Job parameters, range-checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace

STRATEGIES = ("vector", "keyword", "hybrid")
FUSIONS = ("rrf", "score", "union")
EXPANSIONS = ("none", "siblings", "page", "section")


@dataclass(frozen=True)
class SearchConfig:
    """Fixed values of the schema's defaults; ``shipped`` holds the deployed ones."""

    search_strategy: str = "hybrid"
    hybrid_strategy: str = "rrf"
    vector_weight: float = 0.6
    keyword_weight: float = 0.4
    rrf_k: int = 60
    vector_limit: int = 50
    keyword_limit: int = 50
    final_limit: int = 5
    vector_final_limit: int = 5
    keyword_final_limit: int = 5
    score_threshold: float = 0.0
    freshness_boost: float = 0.0
    context_expansion: str = "none"
    context_expansion_size: int = 1
    context_max_tokens: int = 4000
    chunk_size: int = 1500
    chunk_overlap: int = 250
    metadata_stage: str = "post"

    def __post_init__(self) -> None:
        for value, known in ((self.search_strategy, STRATEGIES), (self.hybrid_strategy, FUSIONS), (self.context_expansion, EXPANSIONS), (self.metadata_stage, ("post", "pre"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        for name in ("vector_limit", "keyword_limit", "final_limit", "rrf_k", "chunk_size", "context_max_tokens"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("vector_weight", "keyword_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")


def shipped() -> SearchConfig:
    return replace(SearchConfig(), chunk_size=1000, vector_final_limit=8, keyword_final_limit=4, context_max_tokens=15000)
