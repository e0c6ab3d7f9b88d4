"""The best rows of each query in one pass over the rows: what lexical and vector search share.

Queries go to the tasks in blocks. A task scores its rows against a block with matrix products and keeps
each query's top rows as it goes; the tasks' lists meet in one shuffle. No pair of a query and a row is shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

FIRST = 64  # rows scored before there is any bound


def rounded(x: np.ndarray) -> np.ndarray:
    """Four decimals, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e4 + 0.5) / 1e4


class Kept:
    """The top rows so far of each of n queries: higher rounded scores first, ties by the smaller id."""

    def __init__(self, n: int, top: int, positive: bool):
        self.top, self.positive = top, positive
        self.who, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.floor, self.last = np.full(n, -np.inf), None  # score and id of the last row, where there are top rows

    def add(self, raw: np.ndarray, ids: np.ndarray, agrees: Callable | None = None) -> None:
        """raw: scores of queries by rows before rounding, nan for a pair that doesn't count. agrees(who, row, score)
        says which of the pairs that could enter count."""
        least = np.maximum(self.floor - 1e-4, 1e-5 if self.positive else -np.inf)
        who, row = np.nonzero(raw >= least[:, None])
        score = rounded(raw[who, row])
        enters = score > 0 if self.positive else np.ones(len(score), bool)
        if self.last is not None:
            enters &= (score > self.floor[who]) | ((score == self.floor[who]) & (ids[row] < self.last[who]))
        who, row, score = who[enters], row[enters], score[enters]
        if agrees is not None and len(who):
            fits = agrees(who, row, score)
            who, row, score = who[fits], row[fits], score[fits]
        if not len(who):
            return
        got = ids[row]
        if self.ids is not None:
            who, score, got = np.concatenate([self.who, who]), np.concatenate([self.score, score]), np.concatenate([self.ids, got])
        order = np.lexsort((got, -score, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        order, who, place = order[place < self.top], who[place < self.top], place[place < self.top]
        self.who, self.score, self.ids = who, score[order], got[order]
        full = place == self.top - 1
        self.floor[who[full]] = self.score[full]
        self.last = np.zeros(len(self.floor), self.ids.dtype)
        self.last[who[full]] = self.ids[full]


def best(scored: DataFrame, top: int, by: str = "score", out: str = "rank") -> DataFrame:
    """The top rows of each qid by score, ties by doc_id, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.desc(by), "doc_id")
    return scored.withColumn(out, F.row_number().over(order).cast("long")).filter(F.col(out) <= top)


def whole_id(df: DataFrame, c: str) -> Column:
    return F.col(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c).cast("long")


def over_blocks(queries: DataFrame, rows: DataFrame, top: int, blocks: int, row_block: int, scorer: Callable, positive: bool = False, allowed: Callable | None = None, ready: Callable | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the top of rows(doc_id, ...) for each of queries(qid, ...).

    scorer(asked) prepares a block of queries and returns a pair: at most how many rows it takes at once (none: row_block), and
    a function of a batch of rows that gives their raw scores (queries by rows) and what Kept.add asks, or None. allowed(batch, asked) is a
    boolean matrix over a batch and the block's queries: filters act before ranking. ready(rows, held), if any, makes what is
    scored against a block of rows and the block, which is broadcast."""
    spark = queries.sparkSession
    numbered = queries.withColumn("qid", whole_id(queries, "qid")).withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    if blocks > 1:
        numbered = materialise(numbered, "asked")  # read once for each block
    rows = rows.withColumn("doc_id", whole_id(rows, "doc_id"))
    kinds = {"qid": numbered.schema["qid"].dataType.simpleString(), "doc_id": rows.schema["doc_id"].dataType.simpleString()}
    found = None
    for b in range(blocks):
        held = spark.sparkContext.broadcast(numbered.filter(F.col("_block") == b).drop("_block").toArrow())

        def near(batches, held=held):
            asked = held.value.combine_chunks()
            if not asked.num_rows:
                return
            most, score = scorer(asked)
            most = min(most or row_block, row_block)
            kept, step = Kept(asked.num_rows, top, positive), min(FIRST, most)
            for whole in batches:
                lo = 0
                while lo < whole.num_rows:
                    batch = whole.slice(lo, step)
                    lo, step = lo + step, min(most, 2 * step)
                    if allowed is not None:
                        fits = allowed(batch, asked)
                        some = fits.any(0)
                        if not some.all():
                            batch, fits = batch.filter(pa.array(some)), fits[:, some]  # rows that no query allows aren't scored
                        if not batch.num_rows:
                            continue
                    raw, agrees = score(batch)
                    if allowed is not None:
                        raw = np.where(fits, raw, np.nan)
                    ids = batch["doc_id"]
                    kept.add(raw, np.array(ids.to_pylist(), str) if kinds["doc_id"] == "string" else ids.to_numpy(zero_copy_only=False), agrees)
            if kept.ids is not None:
                yield pa.RecordBatch.from_arrays([asked["qid"].combine_chunks().take(pa.array(kept.who)), pa.array(kept.ids), pa.array(kept.score)], names=["qid", "doc_id", "score"])

        part = (rows if ready is None else ready(rows, held)).mapInArrow(near, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")
        found = part if found is None else found.unionByName(part)
    return best(found, top)
