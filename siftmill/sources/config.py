"""Settings: defaults, a YAML file, environment variables, checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Chunking:
    strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64
    window_size: int = 2
    toc_threshold: float = 0.6


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    prefetch: int = 5
    candidate_mul: int = 3
    rerank: bool = True
    chunk_filter: bool = False
    filter_threshold: float = 0.5
    hyde: bool = False
    hyde_docs: int = 3
    hyde_threshold: float = 0.5


@dataclass(frozen=True)
class Cache:
    enabled: bool = True
    threshold: float = 0.9
    ttl_seconds: int = 0


@dataclass(frozen=True)
class Config:
    paths: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    index: str = "index"
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    cache: Cache = field(default_factory=Cache)


def _fill(kind: type, given: dict, prefix: str, env: dict[str, str]) -> object:
    values = {}
    for f in fields(kind):
        default = f.default if f.default_factory is None or not callable(f.default_factory) else f.default_factory()
        name = f"{prefix}_{f.name}".upper()
        if is_dataclass(default):
            values[f.name] = _fill(type(default), given.get(f.name) or {}, name, env)
            continue
        value = given.get(f.name, default)
        if name in env:
            raw = env[name]
            value = raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else raw.split(",") if isinstance(default, tuple) else type(default)(raw)
        values[f.name] = tuple(value) if isinstance(default, tuple) else value
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "SIFTMILL") -> Config:
    """The file's settings over the defaults, and variables such as SIFTMILL_RETRIEVAL_TOP_K over both."""
    given: dict = {}
    if path:
        import yaml

        with open(path) as file:
            given = yaml.safe_load(file) or {}
    config = _fill(Config, given, prefix, dict(os.environ) if env is None else env)
    if not 0 <= config.chunking.chunk_overlap < config.chunking.chunk_size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")
    if config.chunking.strategy not in ("recursive", "sentence_window"):
        raise ValueError("strategy is recursive or sentence_window")
    if config.retrieval.top_k < 1 or config.retrieval.prefetch < 1:
        raise ValueError("top_k and prefetch are positive")
    return config
