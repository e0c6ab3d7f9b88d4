"""Hash embedding and exact cosine search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .lexical import lowered, text_blocks, token_runs, types_of
from .topk import over_blocks

DIM = 384
QUERY_BLOCK = 1024  # queries that a pass over the vectors serves at once
ROW_BLOCK = 2048


@lru_cache(1 << 17)
def hashed(token: str) -> tuple[int, int]:
    """The token's 128-bit MD5 number, and the sign that its last byte's first bit gives."""
    digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()
    return int.from_bytes(digest, "big"), 1 if digest[15] >= 128 else -1


def dense_vectors(docs: DataFrame, dim: int = DIM, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, vec array<double>, *also) of docs(doc_id, text, *also): unit vectors of the tokens' signed counts by MD5 number modulo dim,
    of the documents that have any."""

    def made(batches):
        for part in text_blocks(batches):
            for lo in range(0, part.num_rows, ROW_BLOCK):
                rows = part.slice(lo, ROW_BLOCK)
                _, names, row, tok, tf = token_runs(rows["text"])
                signed = [hashed(t) for t in names.to_pylist()]
                bucket, sign = np.array([h % dim for h, _ in signed], np.int64), np.array([s for _, s in signed], np.int64)
                sums = np.bincount(row * dim + bucket[tok], tf * sign[tok], rows.num_rows * dim).reshape(rows.num_rows, dim)  # whole numbers
                norm = np.sqrt((sums * sums).sum(1))
                some = norm > 0
                vec = (sums[some] / norm[some, None]).ravel()
                held = pa.array(some)
                yield pa.RecordBatch.from_arrays([rows["doc_id"].filter(held), pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1, dtype=np.int32) * dim), pa.array(vec)), *(rows[c].filter(held) for c in also)], ["doc_id", "vec", *also])

    return lowered(docs, also=also).mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vec array<double>{types_of(docs, also)}")


def embedded(docs: DataFrame, dim: int = DIM, embed: Callable[[Column], Column] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, vec, *also) of docs(doc_id, text, *also): hash vectors, or what embed makes of the text, which must have dim components."""
    if embed is None:
        return dense_vectors(docs, dim, also)
    made = docs.select("doc_id", embed(F.col("text")).cast("array<double>").alias("vec"), *also)
    wrong = F.raise_error(F.format_string(f"the embedder gave %d components, not {dim}", F.size("vec"))).cast("array<double>")
    return made.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(wrong))


def l2_normal(v: Column) -> Column:
    """A vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return bound(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def near(asked: pa.Table, overlap: bool):
    """A scorer for topk.over_blocks: cosines of vectors and queries, over the components that a query has."""
    q = matrix(asked["vec"].combine_chunks())
    used = np.nonzero((q != 0).any(0))[0] if q.shape[1] else np.zeros(0, np.int64)
    held, q_norm = np.ascontiguousarray(q[:, used]), np.sqrt((q * q).sum(1))

    def score(batch: pa.RecordBatch):
        v = matrix(batch["vec"])
        part = np.ascontiguousarray(v[:, used])
        norm = np.outer(q_norm, np.sqrt((v * v).sum(1)))
        with np.errstate(invalid="ignore", divide="ignore"):
            raw = np.where(norm > 0, held @ part.T / norm, np.nan)

        def meets(who, row, score):
            """Pairs with a common non-zero component; only where the cosine is zero may there be none."""
            fits = score != 0
            if not fits.all():
                asking, at = np.unique(who[~fits], return_inverse=True)
                common = (held[asking] != 0).astype(np.float32) @ (part != 0).T.astype(np.float32)
                fits[~fits] = common[at, row[~fits]] > 0
            return fits

        return raw, meets if overlap else None

    return None, score


def cosine_topk(queries: DataFrame, vectors: DataFrame, top: int, overlap: bool = False, allowed=None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(qid, doc_id, score, rank): the nearest of vectors(doc_id, vec) to each of queries(qid, vec), by cosine.

    Exact, in one pass over the vectors for each QUERY_BLOCK queries: a block (some 3 MB)
    goes to all tasks, each task multiplies its vectors with it in blocks of rows and
    keeps its own top rows of each query, and the tasks' lists meet in one shuffle.
    overlap leaves out pairs without a common non-zero component. allowed(rows, asked) is
    a boolean matrix over a batch of vectors and the block's queries, which have the
    columns `extra` too: filters act before ranking."""
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"), *extra)
    return over_blocks(asked, vectors, top, max(1, -(-queries.count() // QUERY_BLOCK)), ROW_BLOCK, lambda block: near(block, overlap), allowed=allowed)
