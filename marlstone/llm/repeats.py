"""Removal of repeated byte strings, by prefix-free parsing over the whole corpus.

A byte is removed if some SPAN-byte string that covers it starts anywhere else too, in
the same document or another; strings don't cross documents.

Parsing. A rolling hash runs over each document. Every SPAN-byte string is anchored at
the smallest of the GRAM-byte hashes inside it (the leftmost among equals), which
depends on the string alone. So anchors, the triggers, cut a document into phrases: the
phrase of an anchor is the text that the strings anchored there cover. Phrases overlap by
SPAN - 1 bytes, so that every string lies inside one, and no phrase is a prefix of the
order that decides about another. The set of distinct phrases is the dictionary, and a
document's sequence of their names its parse.

1. Parse: each block of documents sends the names in its parse, each once with its count,
   to the bucket of their anchor. An anchor that occurs once makes all its strings unique;
   a phrase that occurs twice makes all of its own repeated. What is left are the phrases
   of anchors that have several, told apart by the dictionary:
2. Dictionary: each such phrase is sent once, with its bytes, to its anchor's bucket. The
   bucket builds the suffix array of its phrases (prefix doubling over the bytes, up to
   SPAN of them). Where neighbours in that order share SPAN bytes, both start a repeated
   string. Counts of the parse give the multiplicity; its own suffix array would only order
   what the dictionary leaves equal, behind the SPAN bytes that decide.
3. Repeated starts are joined by document, and runs of covered bytes removed.

An anchor with more than MANY phrases (the edge of a licence that a large share of all
documents have) would fill one task's dictionary. Its strings go the same way one by one
instead, in the order of the hash of their SPAN bytes (128 bits), which can be cut into
buckets that no repetitive text can fill; the outcome is the same.

Scale. Documents are dealt into blocks of about BLOCK_BYTES. A name reaches a bucket once
from each block. Texts are shuffled once (the three uses share the exchange). Phrases are
told apart by 128 bits; anchors by 64, where a false match costs a comparison of bytes and
nothing else. Arrays are made for SLICE_BYTES of texts at a time, or for one longer text.

Edge cases: null and empty texts have no bytes and keep none; texts under SPAN bytes lose
nothing; repeated rows are each judged, as occurrences of one another's strings; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 200
GRAM = 64
MANY = 4096
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 19
PLACE_BITS = 31  # a text has less than 2**31 bytes
NAMES = "bucket int, block int, names binary, counts binary"
ANSWER = "block int, names binary, states binary"
SENT = "kind int, bucket int, block int, names binary, sizes binary, texts binary"
FOUND = "block int, kind int, names binary, sizes binary, bits binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
# What a block is told of a phrase; what it isn't told of has an anchor that occurs once.
WHOLE, ALONE, OWNED, HASHED_ALONE, HASHED_OWNED = 1, 2, 3, 4, 5
TEXTS, STRINGS = 0, 1


class Parsed:
    """The phrases of some texts in a row: their anchors, and the first and last starts of their strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
        self.data, self.span = data, span
        n = len(data)
        none = np.zeros(0, np.int64)
        self.lo = self.hi = none
        self.anchors, self.names = np.zeros(0, C.U64), np.zeros((0, 2), C.U64)
        if n < span:
            return
        self.prefix = C.prefix_hash(data)
        _, down = C.powers(n + 1)
        grams = C.mix((self.prefix[gram:] - self.prefix[:-gram]) * down[: n - gram + 1])
        # the smallest hash with its place behind it: among equals the leftmost is the smallest
        low = C.U64((1 << PLACE_BITS) - 1)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=C.U64)
        anchor = (C.sliding_min(keyed, span - gram + 1) & low).astype(np.int64)
        inside = np.zeros(len(anchor) + 2, bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            inside[a + 1 : max(b - span, a - 1) + 2] = True
        # texts that follow each other without a gap have other anchors, as no string crosses texts
        change = anchor[1:] != anchor[:-1]
        inner = inside[1:-1]
        first = inner & np.concatenate([[True], change | ~inner[:-1]])
        last = inner & np.concatenate([change | ~inner[1:], [True]])
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        self.anchors = C.mix(grams[anchor[self.lo]] ^ C.BASES[1])  # minima are small numbers, and buckets go by the upper bits
        self.other = C.prefix_hash(data, 1)
        ends = self.hi + span
        self.names = np.stack([C.span_hash(self.prefix, self.lo, ends), C.span_hash(self.other, self.lo, ends, 1)], 1)

    def starts(self, which: np.ndarray) -> np.ndarray:
        """All starts of chosen phrases, phrase by phrase."""
        count = self.hi[which] - self.lo[which] + 1
        return np.repeat(self.lo[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """128-bit names of the strings at some starts."""
        ends = starts + self.span
        return np.stack([C.span_hash(self.prefix, starts, ends), C.span_hash(self.other, starts, ends, 1)], 1)


def parses(texts: pa.Array, span: int, gram: int):
    """For slices of the texts: the row that the slice starts at, the offsets of its texts, and their phrases."""
    for lo, hi in C.slices(texts, SLICE_BYTES):
        data, offsets = C.text_bytes(texts.slice(lo, hi - lo))
        yield lo, offsets, Parsed(data, offsets, span, gram)


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of keys in order, each once, with the sum of its counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    counts = np.ones(len(keys), np.int64) if counts is None else counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[at], np.add.reduceat(counts, at)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> C.U64(32)) * C.U64(buckets) >> C.U64(32)).astype(np.int64)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and end."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(values))[: len(at)]


def rows_in(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), C.U64).reshape(-1, width)


def place(every: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Row numbers of own's rows in every (sorted, two columns), -1 where there is none."""
    if not len(every) or not len(own):
        return np.full(len(own), -1)
    at = np.minimum(np.searchsorted(every[:, 0], own[:, 0]), len(every) - 1)
    found = np.where((every[at] == own).all(1), at, -1)
    for k in np.flatnonzero((found < 0) & (every[at, 0] == own[:, 0])):  # several keys share their first half
        j = int(at[k])
        while j < len(every) and every[j, 0] == own[k, 0]:
            if every[j, 1] == own[k, 1]:
                found[k] = j
                break
            j += 1
    return found


def name_answers(table: pa.Table, many: int) -> pa.Table:
    """Of a bucket's anchors, to each block the states of its phrases; one block owns a phrase that several have."""
    blocks, packed = table["block"].to_pylist(), [rows_in([x], 3) for x in table["names"].to_pylist()]
    sizes = [len(x) for x in packed]
    rows, counts = np.concatenate(packed), np.frombuffer(b"".join(table["counts"].to_pylist()), "u1").astype(np.int64)
    who = np.repeat(np.arange(len(blocks)), sizes)
    order = np.lexsort((who, rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, counts, who = rows[order], counts[order], who[order]
    phrase = np.cumsum(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) - 1
    total = np.bincount(phrase, counts).astype(np.int64)
    first = np.concatenate([[True], phrase[1:] != phrase[:-1]])
    anchor = np.cumsum(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) - 1
    occurs, phrases = np.bincount(anchor, counts).astype(np.int64)[anchor], np.bincount(anchor, first).astype(np.int64)[anchor]
    single = total[phrase] == 1
    state = np.where(single, np.where(phrases > many, HASHED_ALONE, ALONE), np.where((phrases > 1) & first, np.where(phrases > many, HASHED_OWNED, OWNED), WHOLE))
    told = occurs > 1
    names, state, who = rows[told, 1:], state[told].astype("u1"), who[told]
    order = np.argsort(who, kind="stable")
    at, to = runs_of(who[order])
    return pa.table({
        "block": pa.array([blocks[who[order[a]]] for a in at], pa.int32()), "names": pa.array([names[order[a:b]].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
        "states": pa.array([state[order[a:b]].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
    })


class Told:
    """What the buckets told a block of its phrases, looked up by name."""

    def __init__(self, table: pa.Table):
        names, states = rows_in(table["names"].to_pylist(), 2), np.frombuffer(b"".join(table["states"].to_pylist()), "u1")
        order = np.lexsort((names[:, 1], names[:, 0]))
        self.names, self.states = names[order], states[order]

    def of(self, names: np.ndarray) -> np.ndarray:
        at = place(self.names, names)
        return np.where(at >= 0, self.states[at] if len(self.states) else 0, 0)


def suffix_order(text: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their span bytes, and whether each shares them with the one before it.

    Prefix doubling: places are ranked by 8 bytes, and then by twice as many from the ranks of
    both halves. Only places that a string needs are ranked."""
    words = np.concatenate([text, np.zeros(8, np.uint8)])
    rank = np.zeros(len(text), C.U64)
    for k in range(8):
        rank = rank << C.U64(8) | words[k : k + len(text)]
    rank = np.unique(rank, return_inverse=True)[1].astype(C.U64)
    width = 8
    while width * 2 <= span:
        longer = np.zeros(len(text), C.U64)
        longer[: len(text) - width] = rank[: len(text) - width] << C.U64(32) | rank[width:]
        rank, width = np.unique(longer, return_inverse=True)[1].astype(C.U64), width * 2
    both = rank[starts] << C.U64(32) | rank[starts + span - width]
    order = np.argsort(both, kind="stable")
    return order, np.concatenate([[False], both[order][1:] == both[order][:-1]])


def dictionary_answers(table: pa.Table, span: int) -> pa.Table:
    """Which strings of a bucket's phrases (or of its strings by name) are repeated, as bits by phrase."""
    kind, blocks = table["kind"][0].as_py(), table["block"].to_pylist()
    packed = [np.frombuffer(x, "<i4") for x in table["sizes"].to_pylist()]
    out = []
    if kind == STRINGS:
        names = [rows_in([x], 2) for x in table["names"].to_pylist()]
        every, total = distinct(np.concatenate(names), np.concatenate(packed))
        every = every[total > 1]
        for block, own in zip(blocks, names, strict=True):
            hit = place(every, own) >= 0
            if hit.any():
                out.append((block, kind, own[hit].tobytes(), b"", b""))
    else:
        text, sizes = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8), np.concatenate(packed)
        ends = np.cumsum(sizes)
        count = sizes - span + 1
        first = np.cumsum(count) - count
        starts = np.repeat(ends - sizes - first, count) + np.arange(int(count.sum()))
        order, same = suffix_order(text, starts, span)
        repeated = np.zeros(len(starts), bool)
        repeated[order[same]] = repeated[order[:-1][same[1:]]] = True
        k = 0
        for block, names, own in zip(blocks, (rows_in([x], 2) for x in table["names"].to_pylist()), packed, strict=True):
            bits = repeated[first[k] : first[k] + int(count[k : k + len(own)].sum())]
            k += len(own)
            if bits.any():
                out.append((block, kind, names.tobytes(), (own - span + 1).astype("<i4").tobytes(), np.packbits(bits).tobytes()))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({name: pa.array([x[j] for x in out], t) for j, (name, t) in enumerate(zip(("block", "kind", "names", "sizes", "bits"), types, strict=True))})


class Dictionary:
    """What the dictionary told a block: the repeated strings of its phrases."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        self.bits: dict[bytes, np.ndarray] = {}
        for r in rows:
            if r["kind"] == TEXTS:
                sizes = np.frombuffer(r["sizes"], "<i4")
                bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
                for k, (at, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)):
                    own = bits[at : at + n]
                    if own.any():
                        self.bits[r["names"][16 * k : 16 * k + 16]] = own
        names = rows_in([r["names"] for r in rows if r["kind"] == STRINGS], 2)
        self.strings = names[np.lexsort((names[:, 1], names[:, 0]))]

    def repeated(self, parsed: Parsed, states: np.ndarray) -> np.ndarray:
        """Starts of repeated strings of the phrases that are not repeated as a whole."""
        out = [np.zeros(0, np.int64)]
        for k in np.flatnonzero(states == ALONE) if self.bits else ():
            own = self.bits.get(parsed.names[k].tobytes())
            if own is not None:
                out.append(parsed.lo[k] + np.flatnonzero(own))
        which = np.flatnonzero(states == HASHED_ALONE)
        if len(which) and len(self.strings):
            starts = parsed.starts(which)
            out.append(starts[place(self.strings, parsed.strings(starts)) >= 0])
        return np.concatenate(out)


def covered_runs(starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that repeated strings cover."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.unique(starts)
    gap = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + span]))
    return starts[gap], np.append(starts[gap[1:] - 1], starts[-1]) + span


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, with_text: bool = False, many: int = MANY) -> DataFrame:
    """Each row of docs(doc_id, text): see RESULT; with_text adds the bytes kept and the spans removed."""
    if not 8 <= gram < span:
        raise ValueError("the anchors' grams must have 8 bytes or more, and strings more than that")
    C.ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def parse(table: pa.Table) -> pa.Table:
        found = [np.column_stack([p.anchors, p.names]) for _, _, p in parses(C.as_texts(table["text"]), span, gram)]
        names, counts = distinct(np.concatenate(found) if found else np.zeros((0, 3), C.U64))
        bucket = bucket_of(names[:, 0], blocks)
        at, to = runs_of(bucket)
        counts = np.minimum(counts, 2).astype("u1")
        return pa.table({
            "bucket": pa.array(bucket[at], pa.int32()), "block": pa.array(np.full(len(at), table["block"][0].as_py()), pa.int32()),
            "names": pa.array([names[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
        })

    told = rows.groupBy("block").applyInArrow(parse, NAMES).groupBy("bucket").applyInArrow(lambda table: name_answers(table, many), ANSWER)

    def dictionary(table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and told.num_rows:
            block, states = table["block"][0].as_py(), Told(told)
            phrases: dict[bytes, tuple[int, bytes]] = {}
            strings = []
            for _, _, p in parses(C.as_texts(table["text"]), span, gram):
                state = states.of(p.names)
                buckets = bucket_of(p.anchors, blocks)
                for k in np.flatnonzero((state == ALONE) | (state == OWNED)).tolist():
                    name = p.names[k].tobytes()
                    if name not in phrases:
                        phrases[name] = (int(buckets[k]), p.data[p.lo[k] : p.hi[k] + span].tobytes())
                which = np.flatnonzero((state == HASHED_ALONE) | (state == HASHED_OWNED))
                if len(which):
                    # a phrase that is repeated as a whole counts twice, wherever else it stands
                    _, once = np.unique(p.names[which], axis=0, return_index=True)
                    which = which[once]
                    for s in (HASHED_ALONE, HASHED_OWNED):
                        own = p.strings(p.starts(which[state[which] == s]))
                        strings.append((own, np.full(len(own), 1 if s == HASHED_ALONE else 2)))
            by_bucket: dict[int, list[tuple[bytes, bytes]]] = {}
            for name, (b, text) in phrases.items():
                by_bucket.setdefault(b, []).append((name, text))
            for b, held in by_bucket.items():
                out.append((TEXTS, b, block, b"".join(n for n, _ in held), np.array([len(t) for _, t in held], "<i4").tobytes(), b"".join(t for _, t in held)))
            if strings:
                names, counts = distinct(np.concatenate([s for s, _ in strings]), np.concatenate([c for _, c in strings]))
                bucket = bucket_of(names[:, 0], blocks)
                for a, b in zip(*runs_of(bucket), strict=True):
                    out.append((STRINGS, int(bucket[a]), block, names[a:b].tobytes(), np.minimum(counts[a:b], 2).astype("<i4").tobytes(), b""))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({name: pa.array([x[j] for x in out], t) for j, (name, t) in enumerate(zip(("kind", "bucket", "block", "names", "sizes", "texts"), types, strict=True))})

    sent = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(dictionary, SENT)
    known = sent.groupBy("kind", "bucket").applyInArrow(lambda table: dictionary_answers(table, span), FOUND)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    answers = told.select("block", none("int", "kind"), "names", "states", none("binary", "sizes"), none("binary", "bits")).unionByName(known.select("block", "kind", "names", none("binary", "states"), "sizes", "bits"))

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        of_names = answers["kind"].is_null()
        states, known = Told(answers.filter(of_names)), Dictionary(answers.filter(pc.invert(of_names)))
        out = []
        for _, offsets, p in parses(C.as_texts(table["text"]), span, gram):
            state = states.of(p.names)
            starts = np.concatenate([p.starts(np.flatnonzero((state == WHOLE) | (state == OWNED) | (state == HASHED_OWNED))), known.repeated(p, state)])
            starts.sort()
            cut = np.searchsorted(starts, offsets)
            for k in range(len(offsets) - 1):
                data = p.data[offsets[k] : offsets[k + 1]]
                a, b = covered_runs(starts[cut[k] : cut[k + 1]] - offsets[k], span)
                digest, at, kept = hashlib.sha256(), 0, []
                for lo, hi in [*zip(a.tolist(), b.tolist(), strict=True), (len(data), len(data))]:
                    digest.update(data[at:lo])
                    if with_text:
                        kept.append(data[at:lo].tobytes())
                    at = hi
                out.append((len(data), int((b - a).sum()), len(a), digest.hexdigest(), b"".join(kept), a.tolist(), b.tolist()))
        columns = {"doc_id": table["doc_id"], "n_bytes": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "n_spans": pa.array([x[2] for x in out], pa.int64()), "kept_sha256": pa.array([x[3] for x in out], pa.string())}
        if with_text:
            columns |= {"kept": pa.array([x[4] for x in out], pa.binary()), "starts": pa.array([x[5] for x in out], pa.list_(pa.int64())), "ends": pa.array([x[6] for x in out], pa.list_(pa.int64()))}
        return pa.table(columns)

    schema = RESULT + (", kept binary, starts array<long>, ends array<long>" if with_text else "")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, schema)
