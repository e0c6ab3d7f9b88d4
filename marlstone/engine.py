"""The search engine put together by its settings: catalogue files to tables, to an index, to ranked rows and turns.

Settings come from marlstone.config (environment or session). An embedder other than 'hash' is a
loader that the caller brings under its name; reranker, live results and language model are
slots of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from .config import Config
from .functions import models
from .operators import safety, search, state, turn
from .sources import catalog, index

Loaders = Mapping[str, Callable[[], Callable]]


@dataclass(frozen=True)
class Engine:
    """An opened index with the settings and the embedder that it is asked by."""

    config: Config
    index: dict[str, DataFrame]
    embed: Callable[[Column], Column] | None

    def search(self, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(qid, rank, doc_id, score) of queries(qid, text, [filters], [k]); the scorer acts where settings say so."""
        return search.search(queries, self.index, scorer=scorer if self.config.rerank else None, **self.parameters())

    def parameters(self) -> dict:
        c = self.config
        return {"k": c.top_k, "alpha": c.alpha, "candidates": c.candidates, "rrf_k": c.rrf_k, "dim": c.dim, "embed": self.embed}

    def results(self, queries: DataFrame, **slots) -> DataFrame:
        return search.results(self.search(queries, **slots), self.index)

    def turns(self, asked: DataFrame, live: DataFrame, **slots) -> DataFrame:
        """Whole turns of asked(qid, text) with live results: see operators.turn.run."""
        hosts = list(self.config.allowed_hosts) or safety.ALLOWED_HOSTS
        return turn.run(asked, self.index, live, hosts=hosts, bound=self.config.revise_bound, **self.parameters(), **slots)

    def cached(self, requests: DataFrame, keys: list[str]) -> DataFrame:
        return state.cached(requests, keys, self.config.cache_seconds)

    def throttled(self, calls: DataFrame, keys: list[str]) -> DataFrame:
        return state.throttle(calls, int(self.config.throttle_seconds * 1e6), keys)


def embedder_of(config: Config, loaders: Loaders | None = None) -> tuple[Callable[[Column], Column] | None, str]:
    """The embedder that settings name, and the name of its space."""
    if config.embedder == "hash":
        return None, "hash"
    if not loaders or config.embedder not in loaders:
        raise ValueError(f"no loader for the embedder {config.embedder!r}: there are hash, {', '.join(sorted(loaders or {}))}")
    return models.embedder(loaders[config.embedder]), f"{config.embedder}:{config.embedding_model}"


def build(spark: SparkSession, csv: str, config: Config, loaders: Loaders | None = None, postings: bool = True) -> DataFrame:
    """Catalogue files to an index in the folder that settings name: a new version of it. Returns the summary of what was read.
    Searches need no postings; lookups by token do."""
    embed, name = embedder_of(config, loaders)
    tables = f"{config.index_folder}/tables"
    summary = catalog.ingest(spark, csv, tables)
    index.write_index(catalog.index_documents(*catalog.load(spark, tables)), f"{config.index_folder}/{config.collection}", config.collection, config.dim, embed, name, postings)
    return summary


def open_engine(spark: SparkSession, config: Config, loaders: Loaders | None = None) -> Engine:
    """The newest index of the collection, if it was built with the embedder that settings name."""
    embed, name = embedder_of(config, loaders)
    return Engine(config, index.open_index(spark, f"{config.index_folder}/{config.collection}", index.signature_of(config.dim, name)), embed)
