"""Rank fusion, two-block reranking, metadata filters, and the result record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import best

RRF_K, ALPHA, TOP_K, MOST = 60, 0.5, 5, 20
FILTER_KEYS = ("price_max", "price_min", "min_rating", "brand", "material", "category_contains")


def clamp_k(k: int | None) -> int:
    return max(1, min(int(k), MOST)) if k and k > 0 else TOP_K


def known_filters(filters: dict) -> dict:
    return {k: v for k, v in filters.items() if k in FILTER_KEYS and v is not None}


def metadata(filters: dict, price="price", rating="rating", brand="brand", material="material", category="category") -> Column:
    """One predicate for all channels; a missing value never passes a filter on it."""
    f, out = known_filters(filters), F.lit(True)
    if "price_max" in f:
        out &= F.col(price).between(0, f["price_max"])
    if "price_min" in f:
        out &= F.col(price) >= f["price_min"]
    if "min_rating" in f:
        out &= F.col(rating) >= f["min_rating"]
    if "brand" in f:
        out &= F.lower(brand) == f["brand"].lower()
    if "material" in f:
        out &= F.lower(material) == f["material"].lower()
    if "category_contains" in f:
        out &= F.contains(F.lower(category), F.lit(f["category_contains"].lower()))
    return out


def fuse(dense: DataFrame, lexical: DataFrame, alpha: float = ALPHA, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two (qid, doc_id, rank) lists: vec_rank, bm25_rank, fused."""
    both = dense.select("qid", "doc_id", F.col("rank").alias("vec_rank")).join(lexical.select("qid", "doc_id", F.col("rank").alias("bm25_rank")), ["qid", "doc_id"], "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    return both.withColumn("fused", F.round(part(alpha, "vec_rank") + part(1 - alpha, "bm25_rank"), 8))


def rerank(fused: DataFrame, scorer: Callable[[DataFrame], DataFrame], top: int = TOP_K, pool_of: DataFrame | None = None) -> DataFrame:
    """The best max(3k, 10) by fused rank are put in the scorer's order; the rest follow in fused order.

    scorer adds a column `rerank` to rows (qid, doc_id, fused, ...). k is top, or each query's
    own by pool_of(qid, _k). Rows without a score, as where a model failed, keep their fused order behind the others."""
    ranked = best(fused, 1 << 30, "fused", "fused_rank")
    if pool_of is None:
        pooled = ranked.withColumn("_pool", F.lit(max(3 * top, 10)))
    else:
        pooled = ranked.join(pool_of.select("qid", F.greatest(F.col("_k") * 3, F.lit(10)).alias("_pool")), "qid")
    scored = scorer(pooled.filter(F.col("fused_rank") <= F.col("_pool")).drop("_pool")).select("qid", "doc_id", "rerank")
    joined = ranked.join(scored, ["qid", "doc_id"], "left")
    key = joined.withColumn("order_key", F.when(F.col("rerank").isNotNull(), F.col("rerank") + 1e6).otherwise(-F.col("fused_rank").cast("double")))
    return best(key, top, "order_key", "rank").drop("order_key")
