"""Array kernels that several text operators share.

Texts are handled as one byte buffer per chunk of rows, and every pass over the
bytes is a whole-array operation. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def byte_values(which: int = 0) -> np.ndarray:
    """A random 64-bit odd value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F) + U64(which * 977)) | U64(1)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base = int(BASES[which])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=U64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            both.append(x)
        have = (both[0], both[1])
        if size <= 1 << 23:
            _POWERS[which] = have
    return have[0][:n], have[1][:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times base**i."""
    up, _ = powers(len(data), which)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(byte_values(which)[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[starts:ends], the same wherever the bytes stand. Lengths take part."""
    _, down = powers(len(prefix), which)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i where that fits."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    return column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, budget: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `budget` bytes each, or of one longer text."""
    _, at = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + budget, "right")) - 1)
        yield lo, hi
        lo = hi


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross texts, and the
    n + 1 offsets of each text's words in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finish[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1] * BASES[0]
    for k in range(1, n):
        out = (out + words[k : len(words) - n + 1 + k]) * BASES[0]
    return mix(out + U64(n))


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it."""
    import io
    import os
    import tempfile
    import zipfile

    import marlstone

    if getattr(spark.sparkContext, "_marlstone_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(marlstone.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("marlstone", os.path.relpath(full, top)))
    to = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with open(to, "wb") as f:  # on the driver, which serves it to the executors
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(to)
    spark.sparkContext._marlstone_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256_text(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
