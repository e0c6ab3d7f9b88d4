"""Search over a stored index: one call for any number of queries, each with its own filters.

index is what sources.index opens: postings, terms, stats, vectors, and documents with the
metadata columns price, rating, brand, material, category, title, sku, asin, ingredients,
url, price_per_oz (those that are there)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import hybrid, lexical, vectors

FILTERS = "struct<price_max:double,price_min:double,min_rating:double,brand:string,material:string,category_contains:string>"
FILTER_NAMES = tuple(f.split(":")[0] for f in FILTERS[7:-1].split(","))
META = ("price", "rating", "brand", "material", "category")
RESULT_COLUMNS = ("sku", "title", "price", "rating", "doc_id", "brand", "ingredients", "url", "price_per_oz", "score")


def filters_of(raw: Column) -> Column:
    """Filters from JSON text: known keys only, nulls left out; null if none is left."""
    return nonempty(F.from_json(raw, FILTERS))


def nonempty(filters: Column) -> Column:
    return F.when(F.coalesce(*[filters[n].cast("string") for n in FILTER_NAMES]).isNotNull(), filters)


def clamped(k: Column, default: int = hybrid.TOP_K) -> Column:
    """k between 1 and 20; the default for none, zero and less."""
    return F.coalesce(F.when(k > 0, F.least(k, F.lit(20))), F.lit(default)).cast("int")


def _mask(rows: pa.RecordBatch, asked: pa.Table) -> np.ndarray:
    """Whether rows' metadata passes each query's filters, queries by rows; a missing value never passes a filter on it."""
    asks = [tuple((f or {}).get(c) for c in FILTER_NAMES) for f in asked["filters"].to_pylist()]
    distinct = {f: k for k, f in enumerate(dict.fromkeys(asks))}  # queries often share theirs
    out = np.ones((len(distinct), rows.num_rows), bool)
    number = lambda c: np.array([np.nan if x is None else float(x) for x in rows[c].to_pylist()])
    words = lambda c: [None if x is None else x.lower() for x in rows[c].to_pylist()]
    uses = lambda *names: any(f[FILTER_NAMES.index(n)] is not None for f in distinct for n in names)
    price, rating = number("price") if uses("price_max", "price_min") else None, number("rating") if uses("min_rating") else None
    held = {c: words(c) for c in ("brand", "material") if uses(c)} | ({"category": words("category")} if uses("category_contains") else {})
    with np.errstate(invalid="ignore"):
        for values, k in distinct.items():
            f = dict(zip(FILTER_NAMES, values, strict=True))
            if f["price_max"] is not None:
                out[k] &= (price >= 0) & (price <= f["price_max"])
            if f["price_min"] is not None:
                out[k] &= price >= f["price_min"]
            if f["min_rating"] is not None:
                out[k] &= rating >= f["min_rating"]
            for c in ("brand", "material"):
                if f[c] is not None:
                    out[k] &= np.array([x == f[c].lower() for x in held[c]], bool)
            if f["category_contains"] is not None:
                out[k] &= np.array([x is not None and f["category_contains"].lower() in x for x in held["category"]], bool)
    return out[[distinct[f] for f in asks]]


def metadata_of(index: dict[str, DataFrame]) -> DataFrame:
    """doc_id and the columns that filters look at; those that the index lacks are null."""
    return index["documents"].select("doc_id", *meta_columns(index["documents"].columns))


def meta_columns(there: Sequence[str]) -> list[Column]:
    """META in its types; those that aren't there are null."""
    kinds = {"price": "double", "rating": "double"}
    return [(F.col(c) if c in there else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in META]


def with_meta(rows: DataFrame, index: dict[str, DataFrame]) -> DataFrame | None:
    """rows of the index with META, where it keeps the documents' own in that table; none where they are elsewhere."""
    if not set(META).intersection(index["documents"].columns) <= set(rows.columns):
        return None
    return rows.select(*[c for c in rows.columns if c not in META], *meta_columns(rows.columns))


def same(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of queries(qid, text, [filters]) the first of those that ask the same, and (qid, _as): whose answer each takes."""
    by = [c for c in ("text", "filters") if c in queries.columns]
    first = materialise(queries.groupBy(*by).agg(F.min("qid").alias("qid")), "asked")
    asks = first.select(F.col("qid").alias("_as"), *[F.col(c).alias(f"_{c}") for c in by])
    agree = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return first, queries.join(asks, reduce(and_, agree)).select("qid", "_as")


def fused(queries: DataFrame, index: dict[str, DataFrame], alpha: float = hybrid.ALPHA, candidates: int = lexical.CANDIDATES, rrf_k: int = hybrid.RRF_K, dim: int = vectors.DIM, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, doc_id, vec_rank, bm25_rank, fused) for queries(qid, text, [filters]): one predicate for both channels.

    embed and dim are those that the index was built with. Hash vectors without a common component don't meet.
    Queries of one text and the same filters are asked once, and each takes that answer."""
    asking = queries
    queries, takes = same(asking)
    each = lambda rows: rows.withColumnRenamed("qid", "_as").join(takes, "_as").select("qid", "doc_id", "vec_rank", "bm25_rank", "fused")
    filtered, overlap = "filters" in queries.columns, embed is None
    asked = vectors.embedded(queries.select(F.col("qid").alias("doc_id"), "text"), dim, embed).withColumnRenamed("doc_id", "qid")
    if not filtered:
        bare = index["vectors"].select("doc_id", "vec")
        return each(hybrid.fuse(vectors.cosine_topk(asked, bare, candidates, overlap=overlap), lexical.bm25(queries, index, top=candidates), alpha, rrf_k))
    asked = asked.join(queries.select("qid", "filters"), "qid")
    rows, texts, meta = with_meta(index["vectors"], index), with_meta(index["forward"], index), metadata_of(index)
    dense = vectors.cosine_topk(asked, index["vectors"].select("doc_id", "vec").join(meta, "doc_id") if rows is None else rows, candidates, overlap=overlap, allowed=_mask, extra=("filters",))
    if texts is None:
        words = lexical.bm25(queries, index, top=candidates, meta=meta, allowed=_mask)
    else:
        words = lexical.bm25(queries, index | {"forward": texts}, top=candidates, own=META, allowed=_mask)
    return each(hybrid.fuse(dense, words, alpha, rrf_k))


def search(queries: DataFrame, index: dict[str, DataFrame], k: int = 0, alpha: float = hybrid.ALPHA, candidates: int = lexical.CANDIDATES, scorer: Callable[[DataFrame], DataFrame] | None = None, **space) -> DataFrame:
    """(qid, rank, doc_id, score) of queries(qid, text, [filters], [k]); scorer reranks the head of each list.

    A query's own k is clamped to 1..20; 0 or none is the default. space (rrf_k, dim, embed) goes to fused(). Where the scorer gives no
    score, as a model that fails does, the fused order stays."""
    own = clamped(F.col("k"), hybrid.clamp_k(k)) if "k" in queries.columns else F.lit(hybrid.clamp_k(k))
    limits = queries.select("qid", own.alias("_k"))
    rows = fused(queries, index, alpha, candidates, **space)
    if scorer is None:
        ranked = lexical.best(rows, hybrid.MOST, "fused").withColumn("score", F.col("fused"))
    else:
        ranked = hybrid.rerank(rows.select("qid", "doc_id", "fused"), scorer, hybrid.MOST, pool_of=limits).withColumn("score", F.coalesce("rerank", "fused"))
    return ranked.join(limits, "qid").filter(F.col("rank") <= F.col("_k")).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def results(found: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Found rows (qid, rank, doc_id, score) with the fields of a search result: blanks are null, numbers
    rounded, a missing sku is the ASIN, and that the id."""
    docs = index["documents"]
    column = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    number = lambda c, n: F.round(F.when(F.col(c) >= 0, F.col(c).cast("double")), n) if c in docs.columns else F.lit(None).cast("double")
    fields = docs.select(
        "doc_id", F.coalesce(column("sku"), column("asin"), F.col("doc_id").cast("string")).alias("sku"), F.coalesce(column("title"), F.lit("")).alias("title"), number("price", 2).alias("price"),
        number("rating", 2).alias("rating"), column("brand").alias("brand"), column("ingredients").alias("ingredients"), column("url").alias("url"), number("price_per_oz", 4).alias("price_per_oz"),
    )
    return found.join(fields, "doc_id").select("qid", "rank", *RESULT_COLUMNS)


def responses(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One response for each query: query, count, and its results in rank order (none: empty)."""
    inner = [c for c in found.columns if c != "qid"]
    held = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("results"))
    none = F.array().cast(held.schema["results"].dataType)
    return queries.join(held, "qid", "left").select("qid", F.col("text").alias("query"), F.coalesce(F.size("results"), F.lit(0)).alias("count"), F.coalesce("results", none).alias("results"))


def relaxed(queries: DataFrame, index: dict[str, DataFrame], **parameters) -> DataFrame:
    """search(), and once more without filters for queries with filters that found nothing: adds `relaxed`.

    The second search has no column of filters, so that it needs no metadata of documents."""
    first = materialise(search(queries, index, **parameters).withColumn("relaxed", F.lit(False)), "found")
    again = queries.filter(F.col("filters").isNotNull()).join(first.select("qid").distinct(), "qid", "left_anti").drop("filters")
    return first.unionByName(search(again, index, **parameters).withColumn("relaxed", F.lit(True)))


def register_functions(spark, index: dict[str, DataFrame], prefix: str = "rag") -> None:
    """SQL access: views of the index, and the table function <prefix>_search(words, k) over them, ranked by BM25."""
    for name in ("postings", "terms", "stats"):
        index[name].createOrReplaceTempView(f"{prefix}_{name}")
    spark.sql(f"""create or replace temporary function {prefix}_search(words string, k int)
      returns table (doc_id bigint, score double, rank int) return
      select doc_id, score, rank from (
        select doc_id, score, cast(row_number() over (order by score desc, doc_id) as int) as rank from (
          select p.doc_id, round(sum(t.idf * p.tf * {lexical.K1 + 1} / (p.tf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * p.doc_len / s.avgdl)) * q.qtf), 4) as score
          from (select tok, count(*) as qtf from (select explode(regexp_extract_all(lower({prefix}_search.words), '([a-z0-9]+)', 1)) as tok) group by tok) q
          join {prefix}_terms t on t.tok = q.tok join {prefix}_postings p on p.tok = q.tok cross join {prefix}_stats s
          group by p.doc_id) where score > 0) where rank <= {prefix}_search.k""")
