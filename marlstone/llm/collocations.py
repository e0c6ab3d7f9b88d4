"""Phrase collocations: frequent phrases by position bitmaps, scored by their weakest cut.

Texts are split into pieces at marks and line ends, and pieces into words. Phrases of one to
LONGEST words are counted within pieces, for each language by itself.

Bitmaps. A block of documents numbers the positions of its words, with a free position
between pieces. Each word has a bitmap over positions, held as its non-zero bytes: (word, byte
number, byte). A phrase's bitmap has the positions of its last words. To extend phrases, their
bitmaps are shifted by one, which falls on the free position at the end of a piece, and ANDed
with those of the words in the same bytes; what isn't zero is the longer phrase's bitmap, and
its bits are counted. This goes depth-first over batches of prefixes, so that memory is
bounded by a batch.

Levels. A phrase is no more frequent than its parts. So for each length, blocks send the counts
of the phrases whose parts (all but the last word, all but the first) are frequent, buckets
sum them over the blocks, and answer each block which of its phrases are frequent. Phrases are
told apart by 96 bits of hash, in which the language takes part. One block, the first that has it,
is told to give a frequent phrase's words.

Scores. Frequent phrases and their parts are joined as tables. Products are decimals of 38
digits, exact up to counts of 10**13. The best of each language come from a window by language
and hash of the phrase, and a second one over what is left of it, so that a language of any size
spreads over tasks.

Edge cases: null and empty texts have no words; a null language is `und`; repeated rows and rows
that share a doc_id all count; ties are ordered by score, count and the phrase's bytes; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import blocks as B
from . import common as C

LONGEST = 3
LEAST = 10
COVERED_PERCENT = 50
BEST = 2000
SPREAD = 64
BATCH = 1 << 16
MARKS = ".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"
COUNT = np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<u4")])
NAME = np.dtype([("a", "<u8"), ("b", "<u4")])
OWNED = np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<i8")])
ANSWER = "block int, level int, names binary, owned binary"
GIVEN = "lang string, words int, phrase string, f long"


def word_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, 0x09, *MARKS.encode()]] = False
    return table


def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


def combined(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of phrases, given as rows of places of their words' hashes."""
    out = np.full(len(places), places.shape[1], C.U64)
    for k in range(places.shape[1]):
        out = C.mix(out * C.BASES[0] + words[places[:, k]])
    return out


def known(told: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of names in told (in the order of a and b), -1 for those that aren't there."""
    out = np.full(len(a), -1)
    if not len(told):
        return out
    at = np.minimum(np.searchsorted(told["a"], a), len(told) - 1)
    near = np.flatnonzero(told["a"][at] == a)
    same = told["b"][at[near]] == b[near]
    out[near[same]] = at[near[same]]
    for k in near[~same].tolist():  # several names share their first half
        for j in range(int(at[k]) + 1, len(told)):
            if told["a"][j] != a[k]:
                break
            if told["b"][j] == b[k]:
                out[k] = j
    return out


def by_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The stable order of names. Nearly always that by a; only where names differ in b alone, b is sorted too."""
    order = np.argsort(a, kind="stable")
    twins = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] != b[order[:-1]])
    return np.lexsort((b, a)) if twins.any() else order


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    at, _ = B.runs_of(keys)
    return keys[at], np.add.reduceat(counts[order], at)


class Block:
    """A block's words, numbered, and their bitmaps."""

    def __init__(self, table: pa.Table):
        lower = C.lower_table()
        self.langs = [NO_LANGUAGE if x is None else x for x in table["lang"].to_pylist()]
        self.words = words = B.Words(C.as_texts(table["text"]), word_table(), lower)
        is_mark = np.zeros(256, np.int64)
        is_mark[list(MARKS.encode())] = 1
        opens = [np.zeros(0, bool)]
        for _, data, starts, ends, at in words.spans():
            marks = np.concatenate([[0], np.cumsum(is_mark[data])])
            own = np.ones(len(starts), bool)
            own[1:] = marks[starts[1:]] > marks[ends[:-1]]
            own[at[:-1][at[:-1] < len(starts)]] = True
            opens.append(own)
        self.position = np.arange(len(words)) + np.cumsum(np.concatenate(opens))
        seeds = {x: seed_of(x) for x in set(self.langs)}
        seed = np.repeat(np.array([seeds[x] for x in self.langs], C.U64), np.diff(words.at))
        first = C.mix(words.h0 ^ seed)
        _, lead, self.ids, self.counts = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
        self.h0, self.h1 = first[lead], C.mix(words.h1[lead] + seed[lead])
        words.h0 = words.h1 = first[:0]  # not needed any more

    def names(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return combined(self.h0, places), (combined(self.h1, places) >> C.U64(32)).astype("<u4")

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' bitmaps in the order of words: word, byte number, byte."""
        keys, bits = totals(self.ids << 40 | self.position >> 3, np.left_shift(1, self.position & 7))
        return keys >> 40, keys & ((1 << 40) - 1), bits.astype(np.uint8)

    def phrases(self, length: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of a length whose parts of one word less are frequent, as rows of places of words, and their counts."""
        word, chunk, bits = self.bitmaps()
        if length == 1:
            keys, counts = totals(word, np.bitwise_count(bits).astype(np.int64))
            return keys[:, None], counts
        every = np.arange(len(self.ids))
        if length == 2:
            held = known(frequent, *self.names(np.arange(len(self.h0))[:, None])) >= 0
            word, chunk, bits = (x[held[word]] for x in (word, chunk, bits))
            every = np.flatnonzero(held[self.ids])
        # the words' bits byte by byte, which is the order of positions
        there = self.ids[every], np.left_shift(1, self.position[every] & 7).astype(np.uint8)
        at_byte = self.position[every] >> 3
        first = np.searchsorted(at_byte, np.arange((int(self.position[-1]) >> 3 if len(self.position) else 0) + 3))
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def deeper(prefixes: np.ndarray, who: np.ndarray, chunk: np.ndarray, bits: np.ndarray) -> None:
            """Extend prefixes (rows of places), whose bitmaps are given as (who, byte number, byte)."""
            depth = prefixes.shape[1]
            for lo in range(0, len(who), BATCH):
                own, at, now = who[lo : lo + BATCH], chunk[lo : lo + BATCH], bits[lo : lo + BATCH]
                # shifted by one: the upper bit goes over into the next byte
                own, at, now = np.concatenate([own, own]), np.concatenate([at, at + 1]), np.concatenate([(now << 1).astype(np.uint8), now >> 7])
                some = now > 0
                own, at, now = own[some], at[some], now[some]
                count = first[at + 1] - first[at]
                other = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                both = np.repeat(now, count) & there[1][other]
                hit = np.flatnonzero(both)
                row = np.repeat(np.arange(len(own)), count)[hit]
                pair = own[row] * len(self.h0) + there[0][other[hit]]
                pairs, counts = totals(pair, np.bitwise_count(both[hit]).astype(np.int64))
                found = np.column_stack([prefixes[pairs // len(self.h0)], pairs % len(self.h0)])
                if depth + 1 < length - 1:
                    stay = np.ones(len(found), bool)
                elif depth + 1 == length - 1:
                    stay = known(frequent, *self.names(found)) >= 0
                else:
                    stay = np.ones(len(found), bool) if length == 2 else known(frequent, *self.names(found[:, 1:])) >= 0
                if depth + 1 == length:
                    out.append((found[stay], counts[stay]))
                    continue
                number = np.searchsorted(pairs, pair)
                go = stay[number]
                deeper(found, number[go], at[row][go], both[hit][go])

        deeper(np.arange(len(self.h0))[:, None], word, chunk, bits)
        if not out:
            return np.zeros((0, length), np.int64), np.zeros(0, np.int64)
        return np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])

    def sends(self, length: int, frequent: np.ndarray) -> np.ndarray:
        """COUNT entries in the order of their names, each once."""
        places, counts = self.phrases(length, frequent)
        a, b = self.names(places)
        order = by_name(a, b)
        a, b, counts = a[order], b[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        out = np.zeros(len(at), COUNT)
        out["a"], out["b"] = a[at], b[at]
        if len(at):
            out["n"] = np.add.reduceat(counts, at)
        return out

    def sizes(self) -> list[tuple[str, int, str, int]]:
        """How many words each language has here, as phrases of no words: see GIVEN."""
        names = sorted(set(self.langs))
        number = {x: k for k, x in enumerate(names)}
        n = np.bincount([number[x] for x in self.langs], np.diff(self.words.at), len(names))
        return [(x, 0, "", int(n[k])) for k, x in enumerate(names) if n[k]]

    def gives(self, length: int, owned: np.ndarray) -> list[tuple[str, int, str, int]]:
        """The words of the phrases of a length in owned: see GIVEN."""
        n = len(self.words) - length + 1
        if n <= 0 or not len(owned):
            return []
        starts = np.flatnonzero(self.position[length - 1 :] - self.position[:n] == length - 1)
        places = np.column_stack([self.ids[starts + k] for k in range(length)])
        first = combined(self.h0, places)
        some = np.flatnonzero(owned["a"][np.minimum(np.searchsorted(owned["a"], first), len(owned) - 1)] == first)
        at = known(owned, first[some], (combined(self.h1, places[some]) >> C.U64(32)).astype("<u4"))
        lead, at = starts[some[at >= 0]], at[at >= 0]
        at, once = np.unique(at, return_index=True)
        order = np.argsort(lead[once])
        lead, at = lead[once][order], at[order]
        out = []
        for lo, data, begin, end, own in self.words.spans():
            base = int(self.words.at[lo])
            for k in range(*np.searchsorted(lead, [base, base + len(begin)]).tolist()):
                first = int(lead[k]) - base
                phrase = b" ".join(data[begin[j] : end[j]].tobytes() for j in range(first, first + length)).decode()
                lang = self.langs[lo + int(np.searchsorted(own, first, "right")) - 1]
                out.append((lang, length, phrase, int(owned["n"][at[k]])))
        return out


def sums(table: pa.Table, level: int, least: int) -> pa.Table:
    """To each block of a bucket the names of its frequent phrases, and the counts of those whose words it gives: see ANSWER."""
    blocks, entries, who = B.received(table, COUNT)
    order = by_name(entries["a"], entries["b"])  # stable: of equal names, those of earlier blocks come first
    own, who = entries[order], who[order]
    new = np.concatenate([[True], (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1])])
    total = np.add.reduceat(own["n"].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    often = total >= least
    told = np.zeros(int(often.sum()), OWNED)
    told["a"], told["b"], told["n"] = own["a"][often], own["b"][often], np.where(new, total, 0)[often]
    who = who[often]
    back = np.argsort(who, kind="stable")
    at, to = B.runs_of(who[back])
    names, owned = [], []
    for a, b in zip(at.tolist(), to.tolist(), strict=True):
        rows = told[back[a:b]]
        only = np.zeros(len(rows), NAME)
        only["a"], only["b"] = rows["a"], rows["b"]
        names.append(B.planes(only))
        owned.append(B.planes(rows[rows["n"] > 0]))
    return pa.table({"block": pa.array([blocks[who[back[a]]] for a in at], pa.int32()), "level": pa.array([level] * len(at), pa.int32()), "names": pa.array(names, pa.binary()), "owned": pa.array(owned, pa.binary())})


def in_order(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    """What a block is told, in the order of names."""
    entries = B.unplaned(parts, kind)
    return entries[by_name(entries["a"], entries["b"])]


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """All phrases of docs(text, lang) that occur `least` times or more in a language, and as phrases of no words
    parts of the languages' numbers of words: see GIVEN."""
    C.ship(docs.sparkSession)
    rows, buckets = B.dealt(docs, block_bytes, F.col("lang").cast("string").alias("lang"))

    def words(table: pa.Table) -> pa.Table:
        return B.sent(table["block"][0].as_py(), Block(table).sends(1, np.zeros(0, NAME)), buckets)

    def longer(level: int):
        def phrases(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows or not told.num_rows:
                return B.sent(0, np.zeros(0, COUNT), buckets)
            return B.sent(table["block"][0].as_py(), Block(table).sends(level, in_order(told["names"].to_pylist(), NAME)), buckets)

        return phrases

    def summed(sent: DataFrame, level: int) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda table: sums(table, level, least), ANSWER)

    levels = [summed(rows.groupBy("block").applyInArrow(words, B.SENT), 1)]
    for level in range(2, longest + 1):
        levels.append(summed(rows.groupBy("block").cogroup(levels[-1].select("block", "names").groupBy("block")).applyInArrow(longer(level), B.SENT), level))

    def given(table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows:
            block = Block(table)
            out += block.sizes()
            parts = list(zip(told["level"].to_pylist(), told["owned"].to_pylist(), strict=True))
            for level in range(1, longest + 1):
                out += block.gives(level, in_order([p for k, p in parts if k == level], OWNED))
        types = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table({name: pa.array([x[k] for x in out], t) for k, (name, t) in enumerate(zip(("lang", "words", "phrase", "f"), types, strict=True))})

    owned = [x.filter(F.octet_length("owned") > 0).select("block", "level", "owned") for x in levels]
    answers = owned[0]
    for more in owned[1:]:
        answers = answers.unionByName(more)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(given, GIVEN)


def scored(phrases: DataFrame, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates of two words or more with their weakest cut, without those that a longer one covers: lang, phrase, a, l, r, score."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    own = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1000000)).withColumn("down", wide("l") * wide("r")).withColumn("score", F.expr("up div down"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.min("a").alias("a"))
    # every run of words inside a longer candidate, with that one's count
    spans = own.filter("words > 2").select("lang", F.col("a").alias("longer"), "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = spans.select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").filter((F.col("longer").isNull()) | (wide("longer") * 100 < wide("a") * covered_percent))
    return left.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))


def ranked(found: DataFrame, best: int = BEST, spread: int = SPREAD) -> DataFrame:
    """found with its rank in its language, the first `best` of each."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).filter(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best).drop("_deal")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered_percent: int = COVERED_PERCENT, best: int = BEST, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The best phrases of each language of docs(doc_id, text, lang): lang, rank, phrase, a, l, r, n, score."""
    given = materialise(frequent_phrases(docs, longest, least, block_bytes), "phrases")
    top = ranked(scored(given.filter("words > 0"), covered_percent), best)
    sizes = given.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
