"""Parameters of the retrieval operators, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


#: The names and defaults of both classes are the method's published settings.
@dataclass(frozen=True)
class MemoryConfig:
    negative_weight: float = 0.275  # lambda: share of the memory that is taken off a query
    recency_decay: float = 0.10  # rho: how fast a concept's weight falls with its age in turns
    override_boost: float = 0.15
    max_concepts: int = 50
    semantic_merge: bool = False
    semantic_merge_threshold: float = 0.85

    def __post_init__(self) -> None:
        if self.negative_weight < 0 or self.recency_decay < 0 or self.override_boost < 0:
            raise ValueError("negative_weight, recency_decay and override_boost must be 0 or more")
        if self.max_concepts < 1:
            raise ValueError("max_concepts must be 1 or more")
        if not 0 < self.semantic_merge_threshold <= 1:
            raise ValueError("semantic_merge_threshold must be in (0, 1]")


@dataclass(frozen=True)
class RetrievalConfig:
    memory: MemoryConfig = MemoryConfig()
    top_k: int = 1000

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise ValueError("top_k must be 1 or more")


def load_config(values: dict[str, Any]) -> RetrievalConfig:
    """A config from parsed JSON; names that it does not know are refused."""
    memory = dict(values.get("memory", {}))
    memory.pop("positive_weight", None)  # known, without effect
    if unknown := (set(values) - {"memory", "top_k"}) | (set(memory) - {f.name for f in fields(MemoryConfig)}):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return RetrievalConfig(replace(MemoryConfig(), **memory), values.get("top_k", 1000))
