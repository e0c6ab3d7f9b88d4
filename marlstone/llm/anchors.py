"""Removal of repeated word passages, by anchors at difference-cover positions.

A window is WINDOW words in a row of one document. A word goes if some window that covers
it also starts earlier: in a document with a smaller doc_id, or earlier in its own.

Anchors. COVER is a difference cover modulo PERIOD: every difference of two numbers modulo
PERIOD is one of two members of COVER. So for any two places i and j there is a shift of
less than PERIOD that brings both to positions in the cover, and two equal windows share an
anchor, GRAM words at the same shift inside both, if GRAM + PERIOD - 1 <= WINDOW. Only
4 of 13 positions are hashed and sent for that:

1. Each block of documents sends the hashes of its anchors, every one once, and learns
   which of them occur more than once anywhere.
2. Extension: those anchors are extended to all windows that hold them. A block sends each
   such window once, by 96 bits of hash, with the smallest doc_id it has it in, and
   learns whether another block has it earlier. Every window that is equal to an earlier
   one is among those, since both hold the anchor that they share.
3. Each block marks the words of windows that start earlier, in it or elsewhere.

Windows are judged on the input, not on what is left. Hashes of anchors only choose windows;
that two windows are equal is decided by 96 bits.

Edge cases: null and empty texts have no words and keep none; texts of fewer words than a
window lose nothing; rows that share a doc_id come in the order of a hash of their texts, and
of equal rows one comes first; a null doc_id comes last; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import common as C

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANSWER = "bucket int, block int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ANCHOR = np.dtype([("a", "<u8")])  # the lowest bit tells that the block has the anchor more than once
PLACED = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8")])
LAST = np.iinfo(np.int64).max


def word_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(x - y) % period for x in cover for y in cover} == set(range(period))


class Block:
    """A block's documents in order, their words, anchors and windows."""

    def __init__(self, table: pa.Table, window: int, period: int, cover: tuple[int, ...], both: bool):
        self.ids = table["doc_id"].combine_chunks().fill_null(LAST).to_numpy()
        order = np.lexsort((table["key"].combine_chunks().to_numpy(), self.ids))
        self.table, self.ids = table.take(pa.array(order)), self.ids[order]
        self.words = B.Words(C.as_texts(self.table["text"]), word_table(), both=both)
        self.window, self.period, self.gram = window, period, window - period + 1
        self.room = self.words.room()
        self.places = np.flatnonzero(np.isin(self.words.place() % period, cover) & (self.room >= self.gram))
        grams = C.gram_hash(self.words.h0, self.gram)
        self.anchors, self.which, count = np.unique(grams[self.places] | C.U64(1), return_inverse=True, return_counts=True)
        self.twice = count > 1

    def sends(self) -> np.ndarray:
        return (self.anchors ^ (~self.twice).astype(C.U64)).view(ANCHOR)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        marks = np.zeros(len(self.words) + self.period + 1, np.int64)
        marks[self.places[repeated[self.which]] + 1] = 1
        total = np.cumsum(marks)
        held = total[self.period : self.period + len(self.words)] > total[: len(self.words)]
        return np.flatnonzero(held & (self.room >= self.window))

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct candidates as PLACED entries, the starts of all candidates, and where the first of each is."""
        starts = self.candidates(repeated)
        first, second = C.gram_hash(self.words.h0, self.window), C.gram_hash(self.words.h1, self.window)
        names = np.zeros(len(starts), PLACED)
        names["a"], names["b"] = first[starts], (second[starts] >> C.U64(32)).astype("<u4")
        order = np.lexsort((names["b"], names["a"]))  # stable: earlier starts come first
        sorted_ = names[order]
        new = np.concatenate([[True], (sorted_["a"][1:] != sorted_["a"][:-1]) | (sorted_["b"][1:] != sorted_["b"][:-1])]) if len(order) else np.zeros(0, bool)
        lead = order[new]
        entries = names[lead]
        entries["doc"] = self.ids[np.searchsorted(self.words.at, starts[lead], "right") - 1]
        return entries, starts, lead


def anchor_answers(table: pa.Table) -> pa.Table:
    """To each block: which of its anchors occur more than once."""
    blocks, entries, who = B.received(table, ANCHOR)
    names = entries["a"] | C.U64(1)
    order = np.argsort(names, kind="stable")
    own, again = names[order], (entries["a"][order] & C.U64(1)).astype(bool)
    at, to = B.runs_of(own)
    repeated = np.zeros(len(names), bool)
    repeated[order] = np.repeat((to - at > 1) | again[at], to - at)
    return answered(table, blocks, who, repeated)


def window_answers(table: pa.Table) -> pa.Table:
    """To each block: which of its windows start earlier in another one."""
    blocks, entries, who = B.received(table, PLACED)
    order = np.lexsort((who, entries["doc"], entries["b"], entries["a"]))
    own = entries[order]
    earlier = np.zeros(len(own), bool)
    earlier[order[1:]] = (own["a"][1:] == own["a"][:-1]) & (own["b"][1:] == own["b"][:-1])
    return answered(table, blocks, who, earlier)


def answered(table: pa.Table, blocks: list[int], who: np.ndarray, bits: np.ndarray) -> pa.Table:
    cuts = np.searchsorted(who, np.arange(len(blocks) + 1))
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int32()), "bits": pa.array(packed, pa.binary())})


def bits_of(answers: pa.Table, names: np.ndarray, buckets: int) -> np.ndarray:
    """The answers for a block's names, which are in the order that they were sent in."""
    out = np.zeros(len(names), bool)
    told = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    bucket = B.bucket_of(names, buckets)
    for a, b in zip(*(x.tolist() for x in B.runs_of(bucket)), strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(told[int(bucket[a])], np.uint8), count=b - a)
    return out


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def kept_texts(words: B.Words, gone: np.ndarray):
    """For each text its words that stay, joined by one space."""
    for lo, data, starts, ends, at in words.spans():
        stay = ~gone[words.at[lo] : words.at[lo] + len(starts)]
        starts, ends = starts[stay], ends[stay]
        at = np.concatenate([[0], np.cumsum(stay)])[at]
        inner = np.ones(len(starts), bool)  # words with another behind them take the byte behind them along
        inner[at[1:][at[1:] > at[:-1]] - 1] = False
        out = data.copy()
        out[ends[inner]] = 0x20
        length = ends - starts + inner
        place = np.concatenate([[0], np.cumsum(length)])
        picked = out[np.repeat(starts - place[:-1], length) + np.arange(int(place[-1]))]
        for a, b in zip(place[at[:-1]].tolist(), place[at[1:]].tolist(), strict=True):
            yield picked[a:b].tobytes()


def remove_passages(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, block_bytes: int = B.BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Each row of docs(doc_id, text): see RESULT; with_text adds the text kept, and starts and ends of the runs of words removed."""
    if not is_cover(cover, period) or period > window:
        raise ValueError("cover must have all differences modulo the period, and the period be no longer than the window")
    C.ship(docs.sparkSession)
    rows, buckets = B.dealt(docs, block_bytes)
    parsed = lambda table, both: Block(table, window, period, cover, both)

    def anchors(table: pa.Table) -> pa.Table:
        return B.sent(table["block"][0].as_py(), parsed(table, False).sends(), buckets)

    def windows(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return B.sent(0, np.zeros(0, PLACED), buckets)
        block = parsed(table, True)
        entries, _, _ = block.windows(bits_of(told, block.anchors, buckets))
        return B.sent(table["block"][0].as_py(), entries, buckets)

    def removed(table: pa.Table, told: pa.Table) -> pa.Table:
        block = parsed(table, True)
        kinds = told["kind"].to_pylist()
        of = lambda kind: told.filter(pa.array([k == kind for k in kinds], pa.bool_()))
        anchors_told, windows_told = of(0), of(1)
        n = len(block.words)
        gone = np.zeros(n, bool)
        if anchors_told.num_rows:
            entries, starts, lead = block.windows(bits_of(anchors_told, block.anchors, buckets))
            again = np.ones(len(starts), bool)
            again[lead] = bits_of(windows_told, entries["a"], buckets)
            gone = covered(starts[again], window, n)
        out: dict[str, list] = {"kept_sha256": [], "kept": [], "starts": [], "ends": []}
        for k, kept in enumerate(kept_texts(block.words, gone)):
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                own = np.concatenate([[0], gone[block.words.at[k] : block.words.at[k + 1]].astype(np.int8), [0]])
                out["kept"].append(kept.decode())
                out["starts"].append(np.flatnonzero(np.diff(own) == 1))
                out["ends"].append(np.flatnonzero(np.diff(own) == -1))
        total = np.concatenate([[0], np.cumsum(gone)])[block.words.at]
        columns = {"doc_id": block.table["doc_id"], "n_words": pa.array(np.diff(block.words.at)), "n_removed": pa.array(np.diff(total)), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if with_text:
            columns |= {"kept": pa.array(out["kept"], pa.string()), "starts": pa.array(out["starts"], pa.list_(pa.int64())), "ends": pa.array(out["ends"], pa.list_(pa.int64()))}
        return pa.table(columns)

    first = rows.groupBy("block").applyInArrow(anchors, B.SENT).groupBy("bucket").applyInArrow(anchor_answers, ANSWER)
    second = rows.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(windows, B.SENT).groupBy("bucket").applyInArrow(window_answers, ANSWER)
    answers = first.selectExpr("0 as kind", "*").unionByName(second.selectExpr("1 as kind", "*"))
    schema = RESULT + (", kept string, starts array<long>, ends array<long>" if with_text else "")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, schema)
