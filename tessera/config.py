"""Defaults, overridable from the environment; plain values that operators take as parameters."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    parent_size: int = 1500
    parent_overlap: int = 200
    child_size: int = 350
    child_overlap: int = 60
    top_k: int = 5
    pool: int = 20
    rrf_k: int = 60
    alpha: float = 0.5
    embedding_dim: int = 1536
    max_parents: int = 4
    max_context_tokens: int = 2000
    query_variations: int = 3
    hypothetical_passages: int = 2

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "TESSERA_") -> "Settings":
        """Fields from TESSERA_<NAME>; what doesn't parse as the field's type is an error."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            if (raw := env.get(prefix + f.name.upper())) is not None:
                found[f.name] = type(f.default)(raw)
        out = cls(**found)
        if out.chunk_overlap >= out.chunk_size or not 0 <= out.alpha <= 1 or out.top_k < 1:
            raise ValueError("settings out of range")
        return out
