"""Settings of the search engine, read from the environment or a session, each in its type."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "MARLSTONE_"


@dataclass(frozen=True)
class Config:
    index_folder: str = "index"
    collection: str = "documents"
    top_k: int = 5
    candidates: int = 25
    rrf_k: int = 60
    alpha: float = 0.5
    rerank: bool = False
    embedder: str = "hash"  # or the name of a loader that the caller brings
    embedding_model: str = "default"
    dim: int = 384
    allowed_hosts: tuple[str, ...] = ()  # empty: the default list
    cache_seconds: float = 120.0
    throttle_seconds: float = 1.0
    revise_bound: int = 1


def coerced(kind: str, raw: str, default):
    """A setting's text in its type; blank is the default. A text that isn't of the type raises."""
    raw = raw.strip()
    if raw == "":
        return default
    if kind == "bool":
        return raw.lower() in ("1", "true", "yes", "on")
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    return {"int": int, "float": float, "str": str}[kind](raw)


def config_of(settings: Mapping[str, str] | None = None) -> Config:
    """From a mapping of names such as MARLSTONE_TOP_K, by default the environment; unset ones are defaults."""
    found = os.environ if settings is None else settings
    return Config(**{f.name: coerced(str(f.type), found[PREFIX + f.name.upper()], f.default) for f in fields(Config) if PREFIX + f.name.upper() in found})


def session_config(spark: SparkSession) -> Config:
    """From the session's settings named marlstone.*, such as marlstone.top_k."""
    held = {f.name: spark.conf.get(f"marlstone.{f.name}", None) for f in fields(Config)}
    return config_of({PREFIX + k.upper(): v for k, v in held.items() if v is not None})
