"""Blocks of documents that learn from all others what their own windows or phrases are.

Documents are dealt into blocks by a hash; an operator makes each block's names (hashes) of
windows or phrases, every name once. Entries go to buckets by ranges of the names, a bucket
sees each name of its range with all blocks that have it, and answers each block. So a name
that a third of all documents have reaches its bucket once from each block, and no block or
bucket grows with the input: their number does.

The texts are shuffled by block once; steps in one plan share that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
SENT = "bucket int, block int, entries binary"


def dealt(docs: DataFrame, block_bytes: int, *more: Column) -> tuple[DataFrame, int]:
    """Rows (block, key, doc_id, text, more columns) of docs, and the number of buckets.

    key is a hash of text and doc_id, and blocks are ranges of it: rows with one doc_id and
    equal texts share a block, and the order by (doc_id, block) is that by (doc_id, key)."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, -(-size // max(BUCKET_BYTES, 2 * block_bytes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    rows = rows.withColumn("key", F.xxhash64("text", "doc_id"))
    # the 32 upper bits of the key, as 0 to 2**32 - 1, cut into equal ranges
    upper = F.shiftright("key", 32) + F.lit(1 << 31)
    return rows.select(F.shiftright(upper * F.lit(blocks), 32).cast("int").alias("block"), "key", "doc_id", "text", *[c for c in rows.columns if c not in ("doc_id", "text", "key")]), buckets


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> C.U64(32)) * C.U64(buckets) >> C.U64(32)).astype(np.int64)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and end."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(values))[: len(at)]


def planes(entries: np.ndarray) -> bytes:
    """Entries by byte places: all first bytes, then all second ones and so on, which compresses well where entries are in order."""
    return entries.view(np.uint8).reshape(len(entries), entries.dtype.itemsize).T.tobytes()


def unplaned(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    """The entries of several planes() in a row."""
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(p, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind)[:, 0] for p in parts if p]])


def sent(block: int, entries: np.ndarray, buckets: int) -> pa.Table:
    """A block's entries (a structured array in the order of its field a) for their buckets: see SENT."""
    bucket = bucket_of(entries["a"], buckets)
    at, to = runs_of(bucket)
    return pa.table({"bucket": pa.array(bucket[at], pa.int32()), "block": pa.array(np.full(len(at), block), pa.int32()), "entries": pa.array([planes(entries[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)], pa.binary())})


def received(table: pa.Table, kind: np.dtype) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of a bucket: the blocks in ascending order, all their entries in a row, and which block (its place) each is from."""
    rows = sorted(zip(table["block"].to_pylist(), table["entries"].to_pylist(), strict=True))
    return [b for b, _ in rows], unplaned([e for _, e in rows], kind), np.repeat(np.arange(len(rows)), [len(e) // kind.itemsize for _, e in rows])


class Words:
    """The words of a block's texts: hashes (two of each word, the second if asked for), and the texts' n + 1 offsets in them.

    Hashing goes slice by slice, or over one longer text; spans() gives the bytes again."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, translate: np.ndarray | None = None, both: bool = True):
        self.texts, self.is_word, self.translate = texts, is_word, translate
        first, second, counts = [np.zeros(0, C.U64)], [np.zeros(0, C.U64)], [np.zeros(1, np.int64)]
        for _, data, starts, ends, at in self.spans():
            first.append(C.span_hash(C.prefix_hash(data), starts, ends))
            if both:
                second.append(C.span_hash(C.prefix_hash(data, 1), starts, ends, 1))
            counts.append(np.diff(at))
        self.h0, self.h1 = np.concatenate(first), np.concatenate(second)
        self.at = np.cumsum(np.concatenate(counts))

    def spans(self):
        """For slices of the texts: number of the first, bytes, starts and ends of words in them, the texts' offsets in words."""
        for lo, hi in C.slices(self.texts, SLICE_BYTES):
            data, offsets = C.text_bytes(self.texts.slice(lo, hi - lo))
            if self.translate is not None:
                data = self.translate[data]
            yield lo, data, *C.word_spans(data, offsets, self.is_word)

    def __len__(self) -> int:
        return int(self.at[-1])

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.at[1:], np.diff(self.at)) - np.arange(len(self))

    def place(self) -> np.ndarray:
        """For each word, its number in its text."""
        return np.arange(len(self)) - np.repeat(self.at[:-1], np.diff(self.at))
