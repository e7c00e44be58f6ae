"""Settings, from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default=None, kind=str):
    return field(default_factory=lambda: kind(os.environ[name]) if name in os.environ else default)


@dataclass(frozen=True)
class Settings:
    # The defaults.
    llm_model: str = _env("LLM_MODEL", "openai/gpt-oss-120b")
    llm_api_key: str | None = _env("LLM_API_KEY")
    embedding_model: str = _env("EMBEDDING_MODEL", "sentence-transformers/all-MiniLM-L6-v2")
    embedding_api_key: str | None = _env("EMBEDDING_API_KEY")
    chunk_size: int = _env("CHUNK_SIZE", 800, int)
    max_graph_depth: int = _env("MAX_GRAPH_DEPTH", 2, int)
    top_k: int = _env("TOP_K", 10, int)
