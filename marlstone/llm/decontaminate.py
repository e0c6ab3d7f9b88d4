"""Benchmark decontamination by winnowing.

Documents and benchmark items become sequences of word hashes. Of each GUARANTEE
consecutive words, winnowing keeps the smallest GRAM-word hash of every window of
GUARANTEE - GRAM + 1 grams, so that a shared run of GUARANTEE words always shares a
kept fingerprint. Document fingerprints are looked up among the benchmark's, and each
hit is extended: the item windows that hold the hit are looked for around it.

Benchmark and documents meet as tables. The benchmark gives two: its kept fingerprints, and
its windows by 128-bit hash with their items. A filter over both (two bits for each hash, of at
most FILTER_BYTES however large the benchmark is) goes to all tasks; it lets all true hits
through, and false ones at a rate that grows as it fills. In one pass over the texts each
document keeps the fingerprints that pass, extends them to the windows around, and writes
those windows that pass too. Windows are then joined by hash, which decides. The way is the
same for a benchmark of any size; a window that a large share of the documents have is a hot
key of that join, which adaptive execution splits.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item
matches nothing; items with a null id match nothing; an item id that occurs in several
rows counts once; repeated document rows are each reported; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import common as C

WINDOW = 10
GRAM = 5
FILTER_BYTES = 16 << 20
FOUND = "row_key long, n_words long, windows array<struct<n:int,a:bigint,b:bigint,start:int>>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def word_table() -> np.ndarray:
    """Words are runs of digits, a-z after lower-casing, and bytes of non-ASCII characters."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def word_hashes(data: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    data = C.lower_table()[data]
    starts, ends, at = C.word_spans(data, offsets, word_table())
    return C.span_hash(C.prefix_hash(data, which), starts, ends, which), at


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the smallest of some `width` consecutive ones."""
    if len(grams) < width:
        return np.arange(len(grams)) if len(grams) else np.zeros(0, np.int64)
    least = C.sliding_min(grams, width)
    # the largest minimum among the windows that hold a position is its own value iff some window kept it
    padded = np.concatenate([np.zeros(width - 1, C.U64), least, np.zeros(width - 1, C.U64)])
    best = ~C.sliding_min(~padded, width)
    return np.flatnonzero(best == grams)


def at_places(words: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on, as gram_hash has them."""
    out = words[places] * C.BASES[0]
    for k in range(1, n):
        out = (out + words[places + k]) * C.BASES[0]
    return C.mix(out + C.U64(n))


class Bits:
    """The filter: two bits for each hash, in a power of two of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = C.U64(8 * len(bits) - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return hashes & mask, hashes >> C.U64(32) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        first, second = ((self.bits[at >> C.U64(3)] >> (at & C.U64(7)).astype(np.uint8)) & np.uint8(1) > 0 for at in self.places(hashes, self.mask))
        return first & second


def windows_of(benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The benchmark's windows (n, a, b, item) and kept fingerprints (hash), each once."""
    C.ship(benchmark.sparkSession)

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, offsets = C.text_bytes(C.as_texts(pa.array([text])))
                (one, _), (two, _) = word_hashes(data, offsets), word_hashes(data, offsets, 1)
                n = min(len(one), window)
                if not n:
                    continue
                a, b = C.gram_hash(one, n), C.gram_hash(two, n)
                grams = C.gram_hash(one, gram) if n == window else np.zeros(0, C.U64)
                kept = grams[winnow(grams, window - gram + 1)]
                rows = len(a) + len(kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(a) + [0] * len(kept), pa.int32()), pa.array(np.concatenate([a, kept]).view(np.int64)), pa.array(np.concatenate([b, kept]).view(np.int64)), pa.array([item] * rows, pa.string())],
                    names=["n", "a", "b", "item"],
                )

    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = materialise(items.mapInArrow(cut, "n int, a bigint, b bigint, item string"), "windows")
    return rows.filter("n > 0").distinct(), rows.filter("n = 0").select(F.col("a").alias("hash")).distinct()


def filters(windows: DataFrame, prints: DataFrame, most_bytes: int = FILTER_BYTES):
    """A broadcast of the lengths of windows there are and the filter over all hashes. Tasks set their
    bits; only the bits come to the driver."""
    hashes = windows.select(F.col("a").alias("hash")).unionByName(prints)
    n = hashes.count()
    size = min(most_bytes, 1 << max(10, (8 * n).bit_length()))  # 64 to 128 bits for each hash: one in some 1000 others passes
    part = min(size, 1 << 16)

    def bits(batches):
        own = np.zeros(size, np.uint8)
        for batch in batches:
            for at in Bits.places(batch.column(0).to_numpy().view(C.U64), C.U64(8 * size - 1)):
                np.bitwise_or.at(own, (at >> C.U64(3)).astype(np.int64), np.uint8(1) << (at & C.U64(7)).astype(np.uint8))
        parts = [k for k in range(0, size, part) if own[k : k + part].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // part for k in parts], pa.int32()), pa.array([own[k : k + part].tobytes() for k in parts], pa.binary())], names=["part", "bits"])

    def united(table: pa.Table) -> pa.Table:
        out = np.zeros(part, np.uint8)
        for x in table["bits"].to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros(size, np.uint8)
    for r in hashes.mapInArrow(bits, "part int, bits binary").groupBy("part").applyInArrow(united, "part int, bits binary").collect():
        whole[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["bits"], np.uint8)
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # as many as a window has words at most
    return windows.sparkSession.sparkContext.broadcast((lengths, whole))


def candidates(texts: pa.Array, lengths: list[int], bits: Bits, window: int, gram: int):
    """For each text its number of words, and its windows that pass the filter: (n, a, b, start)."""
    for lo, hi in C.slices(texts):
        data, offsets = C.text_bytes(texts.slice(lo, hi - lo))
        words, at = word_hashes(data, offsets)
        doc_end, found = np.repeat(at[1:], np.diff(at)), []
        for n in lengths:
            if len(words) < n:
                continue
            if n == window:
                grams = C.gram_hash(words, gram)
                kept = winnow(grams, n - gram + 1)
                kept = kept[bits.has(grams[kept])]
                near = np.unique((kept[:, None] - np.arange(n - gram + 1)[None, :]).ravel())
                near = near[(near >= 0) & (near <= len(words) - n)]
                hashes = at_places(words, near, n)
            else:  # of a shorter item each run of n words is a fingerprint
                hashes = C.gram_hash(words, n)
                near = np.arange(len(hashes))
            ok = bits.has(hashes) & (near + n <= doc_end[near])
            if ok.any():
                found.append((n, near[ok], hashes[ok]))
        out: list[list] = [[] for _ in range(hi - lo)]
        if found:
            other, _ = word_hashes(data, offsets, 1)
            for n, near, hashes in found:
                doc = np.searchsorted(at, near, "right") - 1
                for d, a, b, start in zip(doc.tolist(), hashes.view(np.int64).tolist(), at_places(other, near, n).view(np.int64).tolist(), (near - at[doc]).tolist(), strict=True):
                    out[d].append({"n": n, "a": a, "b": b, "start": start})
        for k in range(hi - lo):
            yield int(at[k + 1] - at[k]), out[k]


def marked(docs: DataFrame, row: Column, windows: DataFrame, prints: DataFrame, window: int, gram: int, filter_bytes: int) -> DataFrame:
    """What `row` takes of each row of docs as `_row`, with row_key, n_words and the windows that may be the benchmark's, written once."""
    shared = filters(windows, prints, filter_bytes)

    def mark(batches):
        lengths, raw = shared.value
        bits, key = Bits(raw), TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32())]))]
        for batch in batches:
            found = list(candidates(C.as_texts(batch.column(1)), lengths, bits, window, gram))
            columns = [range(key, key + len(found)), [f[0] for f in found], [f[1] for f in found]]
            key += len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["_row", "row_key", "n_words", "windows"])

    own = docs.select(row.alias("_row"), F.col("text").alias("_text"))
    return materialise(own.mapInArrow(mark, f"_row {own.schema['_row'].dataType.simpleString()}, {FOUND}"), "marked", compression="zstd")


def hits(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The benchmark's windows in marked rows: row_key, start, n, item."""
    asked = rows.filter(F.size("windows") > 0).select("row_key", F.inline("windows"))
    return asked.join(windows, ["n", "a", "b"]).select("row_key", "start", "n", "item")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of docs in which no item window occurs, as they are."""
    windows, prints = windows_of(benchmark, window, gram)
    rows = marked(docs, F.struct("*"), windows, prints, window, gram, filter_bytes)
    bad = hits(rows, windows).select("row_key").distinct()
    untouched, doubtful = rows.filter(F.size("windows") == 0), rows.filter(F.size("windows") > 0)
    return untouched.unionByName(doubtful.join(bad, "row_key", "left_anti").select(*rows.columns)).select("_row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row for each row of docs(doc_id, text): see RESULT."""
    windows, prints = windows_of(benchmark, window, gram)
    rows = marked(docs, F.col("doc_id").cast("long"), windows, prints, window, gram, filter_bytes)
    found = hits(rows, windows)
    items = found.groupBy("row_key").agg(F.collect_set("item").alias("items"))
    # words under hits: starts in order, each hit adding what lies behind the furthest end so far
    spans = found.select("row_key", F.struct("start", "n").alias("s")).distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["n"]).alias("end"))
    known = items.join(spans.select("row_key", F.aggregate("spans", start, step, lambda a: a["n"]).alias("n_hit")), "row_key")
    listed = F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ",")
    return rows.select("row_key", F.col("_row").alias("doc_id"), "n_words").join(known, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
