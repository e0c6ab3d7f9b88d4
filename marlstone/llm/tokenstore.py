"""A content-addressed store of token ids.

Each document's id stream is cut into chunks where a rolling hash over its last ids
meets a mask, so that equal passages give equal chunks wherever they stand. A chunk is
named by the SHA-256 of its bytes and stored once. A document is its recipe: the names
of its chunks. Recipes are written in ascending doc_id order with the number of ids
before each document; each carries the Merkle root over its chunk names.

The manifest is a Merkle tree over all recipes in their order. A leaf covers a recipe's
place, doc_id, start, n_tokens and root; a parent covers up to FANOUT children, which is
what one group of one aggregation holds, whatever the corpus. The top is the one node of
the highest level.

    folder/chunks     chunk binary(32), n int, payload binary (ids, 2 or 4 bytes each)
    folder/recipes    at (place in the order), doc_id, start, n_tokens, chunks, root
    folder/manifest   level, node, digest: parents of recipes are of level 1

Chunk boundaries look only at the ids, within MIN_CHUNK and MAX_CHUNK.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts first; rows
with one doc_id follow in the order they were read; other columns are ignored; an empty
table gives empty files. A chunk whose bytes don't have its name, a chunk that a recipe
names and the store lacks, a recipe whose chunks don't have its root, and a recipe that
the manifest doesn't cover raise on reading.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, shared_folder
from . import common as C
from ..ordering import ranged, shifts
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MASK_BITS = 9
MIN_CHUNK = 128
MAX_CHUNK = 4096
FANOUT = 1024
STAGED = "row_key long, doc_id long, n_tokens long, chunks array<binary>, root binary, fresh array<struct<chunk:binary,n:int,payload:binary>>"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def rolled(ids: np.ndarray) -> np.ndarray:
    """At each id a 32-bit hash of it and the 15 ids before it: each id's own value, shifted once for each id that follows."""
    h = C.mix(ids.astype(C.U64) + C.U64(1)).astype(np.uint32)
    for k in (1, 2, 4, 8):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    return h


def boundaries(ids: np.ndarray, at: np.ndarray | None = None, mask_bits: int = MASK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[list[int]]:
    """For each of the streams ids[at[k]:at[k + 1]] the ends of its chunks in ids. As no chunk but a
    stream's only one is shorter than the hash looks back, what stands before a stream has no say."""
    at = np.array([0, len(ids)]) if at is None else at
    marks = np.flatnonzero(rolled(ids) >> np.uint32(32 - mask_bits) == 0) + 1
    cut = np.searchsorted(marks, at).tolist()
    marks, places = marks.tolist(), at.tolist()
    out = []
    for k in range(len(places) - 1):
        start, stop, own = places[k], places[k + 1], []
        for e in [*marks[cut[k] : cut[k + 1]], stop]:
            while e - start > most:
                start += most
                own.append(start)
            if e - start >= least or e == stop:
                if e > start:
                    own.append(e)
                start = e
        out.append(own)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\x01" + leaves[k] + leaves[k + 1]).digest() for k in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return leaves[0]


def write_store(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    spark = docs.sparkSession
    C.ship(spark)
    fresh_type = pa.list_(pa.struct([("chunk", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())]))

    def stage(batches):
        row = TaskContext.get().partitionId() << 33
        own = encoder(tokenizer)
        narrow = np.dtype("<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        seen: set[bytes] = set()  # a task sends each chunk once; it holds no more names than its input has
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, ids, at in own.batches(batch.column(1), end_id):
                raw, width = memoryview(ids.astype(narrow).tobytes()), narrow.itemsize
                begin, recipes, roots, fresh = 0, [], [], []
                for ends in boundaries(ids, at):
                    names, new = [], []
                    for e in ends:
                        payload = raw[begin * width : e * width]
                        name = hashlib.sha256(payload).digest()
                        names.append(name)
                        if name not in seen:
                            seen.add(name)
                            new.append({"chunk": name, "n": e - begin, "payload": bytes(payload)})
                        begin = e
                    recipes.append(names)
                    roots.append(merkle(names))
                    fresh.append(new)
                n = len(recipes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), doc_ids.slice(lo, n), pa.array(np.diff(at)), pa.array(recipes, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(fresh, fresh_type)],
                    names=["row_key", "doc_id", "n_tokens", "chunks", "root", "fresh"],
                )
                row += n

    staged = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stage, STAGED), "staged", compression="zstd")
    # what several tasks sent under one name has the same bytes: any of it is the chunk
    chunks = staged.select(F.inline("fresh")).groupBy("chunk").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")

    ordered = ranged(staged.drop("fresh"), ["doc_id", "row_key"], "recipes")
    before = shifts(ordered, [], F.col("n_tokens")).withColumnRenamed("_before", "_ids").join(shifts(ordered, [], F.lit(1)), "_part")
    running = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(F.broadcast(before), "_part").withColumn("start", F.col("_ids") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
    placed = placed.select((F.col("_before") + F.col("_row")).alias("at"), "doc_id", "start", "n_tokens", "chunks", "root")
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    manifest(spark, folder).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str, fanout: int = FANOUT) -> DataFrame:
    """The inner nodes of the Merkle tree over the store's recipes."""

    def parents(nodes: DataFrame, level: int) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct("at", "digest")))
        return nodes.groupBy((F.col("at") / fanout).cast("long").alias("node")).agg(F.sha2(F.concat_ws(",", F.transform(children, lambda x: x["digest"])).cast("binary"), 256).alias("digest")).select(F.lit(level).alias("level"), "node", "digest")

    recipes = spark.read.parquet(f"{folder}/recipes")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    leaf: Column = F.sha2(F.concat_ws(":", text("at"), text("doc_id"), text("start"), text("n_tokens"), F.hex("root")).cast("binary"), 256)
    levels = [materialise(parents(recipes.select("at", leaf.alias("digest")), 1), "manifest")]
    while levels[-1].count() > 1:
        levels.append(materialise(parents(levels[-1].select(F.col("node").alias("at"), "digest"), len(levels) + 1), "manifest"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def verify_manifest(spark: SparkSession, folder: str) -> bool:
    """Whether the recipes are those that the manifest was made for."""
    now, then = manifest(spark, folder), spark.read.parquet(f"{folder}/manifest")
    return now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


class Crc:
    """crc32 of a concatenation from its parts' crc32s and lengths, by tables for 2**k zero bytes."""

    def __init__(self):
        def times(rows: list[int], x: int) -> int:
            out = 0
            for r in rows:
                if x & 1:
                    out ^= r
                x >>= 1
                if not x:
                    break
            return out

        bit = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
        for _ in range(3):
            bit = [times(bit, r) for r in bit]
        self.tables = []
        for _ in range(44):
            self.tables.append([[times(bit, b << s) for b in range(256)] for s in (0, 8, 16, 24)])
            bit = [times(bit, r) for r in bit]

    def join(self, crc: int, more: int, length: int) -> int:
        k = 0
        while length:
            if length & 1:
                a, b, c, d = self.tables[k]
                crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
            length >>= 1
            k += 1
        return crc ^ more


def _payload_ids(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def checked_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes, once their chunks have been held against their roots."""

    def check(batches):
        for batch in batches:
            if any(merkle(names) != root for names, root in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                raise ValueError("a document of the token store doesn't have the chunks that its root says")
            yield batch.select(range(5))

    return spark.read.parquet(f"{folder}/recipes").select("at", "doc_id", "start", "n_tokens", "chunks", "root").mapInArrow(check, "at long, doc_id long, start long, n_tokens long, chunks array<binary>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document in the store: where it starts, its length and the crc32 of its ids.

    Each stored chunk is read once and checked against its name; documents combine the
    checksums of their chunks, so that payloads are not shuffled."""
    C.ship(spark)

    def checked(batches):
        for batch in batches:
            names, sizes, payloads = (batch.column(k).to_pylist() for k in range(3))
            if any(hashlib.sha256(p).digest() != name for name, p in zip(names, payloads, strict=True)):
                raise ValueError("a chunk of the token store doesn't have the bytes that its name says")
            crcs = [zlib.crc32(_payload_ids(p, n)) for p, n in zip(payloads, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["chunk", "n", "crc"])

    sums = spark.read.parquet(f"{folder}/chunks").select("chunk", "n", "payload").mapInArrow(checked, "chunk binary, n int, crc long")
    used = checked_recipes(spark, folder).select("at", "doc_id", "start", "n_tokens", F.posexplode("chunks").alias("seq", "chunk")).join(sums, "chunk", "left")
    parts = used.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
    whole = parts.select("doc_id", "start", "n_tokens", F.col("parts.n").alias("ns"), F.col("parts.crc").alias("crcs"))

    def combined(batches):
        crc = Crc()
        for batch in batches:
            out = []
            for n, ns, crcs in zip(*(batch.column(k).to_pylist() for k in range(2, 5)), strict=True):
                if None in ns or sum(ns) != n:
                    raise ValueError("the token store lacks a chunk of a document")
                total = crcs[0]
                for size, own in zip(ns[1:], crcs[1:], strict=True):
                    total = crc.join(total, own, 4 * size)
                out.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(combined, RESULT)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their ids, for readers that need them all: doc_id, start, ids array<long>."""
    C.ship(spark)

    def decoded(batches):
        for batch in batches:
            ids = [_payload_ids(p, n).astype(np.int64) for p, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["chunk", "ids"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("chunk", "n", "payload").mapInArrow(decoded, "chunk binary, ids array<long>")
    used = checked_recipes(spark, folder).select("at", "doc_id", "start", "n_tokens", F.posexplode("chunks").alias("seq", "chunk")).join(chunks, "chunk", "left")
    whole = used.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"])).alias("ids"))
    lacking = F.raise_error(F.lit("the token store lacks a chunk of a document")).cast("array<bigint>")
    return whole.select("doc_id", "start", F.when(F.size("ids") == F.col("n_tokens"), F.col("ids")).otherwise(lacking).alias("ids"))


def store_round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write docs to a new store in the shared folder and read their digests back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/marlstone-tokens-{uuid.uuid4().hex}"
    write_store(docs, folder, tokenizer, end_id)
    if not verify_manifest(spark, folder):
        raise ValueError("the token store's recipes are not those that its manifest covers")
    return read_digests(spark, folder)
