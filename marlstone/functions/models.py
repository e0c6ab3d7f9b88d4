"""Slots for models: a Python callable becomes a Column function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Callable[[Column], Column]:
    """load() is called once in each worker; what it returns maps texts to rows of numbers."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            out: list = []
            values = texts.fillna("").tolist()
            for k in range(0, len(values), batch):
                rows = np.asarray(model([t or " " for t in values[k : k + batch]]), np.float32)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                out += list(rows / np.where(norm > 0, norm, 1))
            yield pd.Series(out)

    return embed


def scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A reranker: load() gives a function from (query, document) pairs to scores."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, documents in parts:
            yield pd.Series(list(map(float, model(list(zip(queries, documents, strict=True))))))

    return score


def generator(load: Callable[[], Callable[[str, str], str]]) -> Callable[[Column, Column, Column], Column]:
    """A language model: load() gives a function (system, user) -> text; where it fails, the third column stands in."""

    @F.pandas_udf("string")
    def generate(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()

        def one(system, user, fallback):
            try:
                return model(system, user)
            except Exception:  # any failure of an outside model
                return fallback

        for systems, users, fallbacks in parts:
            yield pd.Series([one(*x) for x in zip(systems, users, fallbacks, strict=True)])

    return generate
