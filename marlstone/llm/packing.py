"""Best-fit decreasing packing of token sequences.

A document's pieces are placed longest first, each in the open sequence that it leaves
the least room in. Pieces of one length are alike, so the packer places whole lengths:
it takes the histogram of lengths (at most `capacity` rows, whatever the corpus), keeps
open sequences as runs of equal remaining capacity, and finds the tightest run that a
length fits in by a segment tree over the remaining capacities. That gives exactly the
sequences of best-fit decreasing over all pieces one by one, globally and not by
partition. Each piece then takes its place by its rank among the pieces of its length.

Edge cases: a null or empty text is one piece, the end token; repeated rows are packed
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import common as C
from ..ordering import shifts
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
PIECES = "_part int, doc_id long, piece int, start long, length long, ids_crc32 long, _rank long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
RANK_BITS = 40


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: which are there, and the least one from a size on."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.there = [False] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        node = capacity + self.size
        self.there[node] = there
        while node > 1:
            node //= 2
            self.there[node] = self.there[2 * node] or self.there[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        node = size + self.size
        while not self.there[node]:
            while node & 1:  # a right child: its parent has nothing further right
                node //= 2
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # went past the last leaf of this level
                return None
        while node < self.size:
            node = 2 * node if self.there[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for the pieces of each length, and how many sequences there are.

    A place (length, first_rank, first_sequence, each, offset): the pieces of that length
    from first_rank on lie `each` to a sequence, from first_sequence on, behind offset.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    places, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            runs[room].append((first, count))
            tree.set(room, True)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, count = capacity, opened, -(-left // (capacity // size))
                opened += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // size
            placed = min(left, each * count)
            full, rest = divmod(placed, each)
            places.append((size, rank, first, each, capacity - room))
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            put(room, first + full + bool(rest), count - full - bool(rest))
            left, rank = left - placed, rank + placed
    return places, opened


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its rank among those of its length in its partition; with_ids adds its ids (little-endian, 32 bits each)."""
    C.ship(docs.sparkSession)

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        own = encoder(tokenizer)
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else []))
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids, at in own.batches(batch.column(1), end_id):
                raw, at = memoryview(ids).cast("B"), at.tolist()
                out: list[tuple] = []
                for k in range(len(at) - 1):
                    n = at[k + 1] - at[k]
                    lo, size = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        begin = 4 * (at[k] + lo)
                        held = raw[begin : begin + 4 * size]
                        out.append((part, doc_ids[row + k], piece, lo, size, zlib.crc32(held), seen[size], *([bytes(held)] if with_ids else [])))
                        seen[size] += 1
                        lo, size = lo + size, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["_part", "doc_id", "piece", "start", "length", "ids_crc32", "_rank", *(["_ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + (", _ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Where each piece of docs(doc_id, text) lies: see RESULT; with_ids adds its ids, array<int>."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces", compression="zstd" if with_ids else "snappy")
    lengths = cut.groupBy("length").count().collect()  # at most `capacity` rows
    places, _ = best_fit_decreasing({int(r[0]): int(r[1]) for r in lengths}, capacity)
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0] << RANK_BITS | table[:, 1], table))
    before = shifts(cut, ["length"], F.lit(1))
    ranked = cut.join(before, ["length", "_part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"), *(["_ids"] if with_ids else []))

    def place(batches):
        keys, table = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = table[np.searchsorted(keys, length << RANK_BITS | rank, "right") - 1]
            within = rank - at[:, 1]
            columns, names = [*batch.columns[:5], pa.array(at[:, 2] + within // at[:, 3]), pa.array(at[:, 4] + within % at[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                flat = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(place, RESULT + (", ids array<int>" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences to train on: sequence_id, ids, and where its pieces start, of pack(..., with_ids=True)."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_pieces"))  # a sequence has at most `capacity` ids
    return held.select("sequence_id", F.flatten(F.transform("_pieces", lambda x: x["ids"])).alias("ids"), F.transform("_pieces", lambda x: x["offset"]).alias("starts"))
