"""Near-duplicate groups: MinHash with tensored banding, and exact verification.

A document is the set of its distinct word shingles. Documents are linked if the Jaccard
similarity of their sets is at least SIMILAR_PERCENT / 100, and groups are the connected
components of all links. Steps:

1. One pass makes each document's set fingerprint and its MinHash sub-keys. Documents
   with equal sets are one class from there on, however many copies there are.
2. Tensored banding: two small collections of SUBKEYS sub-keys each (ROWS minima to a
   sub-key). A table's key is a pair of sub-keys, one from each collection, so that
   2 * SUBKEYS * ROWS minima serve SUBKEYS ** 2 tables. A pair of similarity s shares a
   table unless one collection fails: 2 * (1 - s ** ROWS) ** SUBKEYS, which is under
   1e-5 at 0.8 for the defaults. Classes that share no sub-key on one side are left out
   before any key is formed.
3. In each table's group the class that shares the most sub-keys with others is the hub;
   each member is compared with the hub, not with the other members.
4. Comparison is exact, on the full sets; verified links are joined into components.
5. A member that is in another component than its hub is compared with the hub's other
   members too, so that no link is lost for want of a hub. Each is held as its difference
   from the hub: shingles added and shingles missing. If less than SIMILAR_PERCENT of the
   member's shingles are the hub's, then any text similar to it must share some of its
   added shingles, and one of any fifth (and one more) of them: those are looked up among
   the others' added shingles. If not, its overlap with all is counted. Comparison is
   exact from the differences. Only links leave the task, not pairs. A hub's members are
   dealt over tasks in chunks, to each of which its open members are sent.

The hash of a shingle has 64 bits, the fingerprint of a set 128. Classes are identified
by their fingerprint; a component by the smallest doc_id in it. Rows are told apart by
doc_id and the md5 of their text.

Edge cases: null, empty and wordless texts have empty sets, are linked with nothing, and
are kept; a text of fewer words than a shingle has one shingle, the whole text; repeated
rows and rows that share a doc_id are all reported; a component_id is null where no row of
the component has a doc_id, and then all of its rows are kept;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialised, materialise
from . import common as C

SHINGLE = 4
SIMILAR_PERCENT = 80
SUBKEYS = 12
ROWS = 2
CHUNK = 20_000
FILE_EDGES = 4096  # of a round of components, to a file
SIGNED = "doc_id long, text_key binary, n_shingles long, class binary, subkeys array<long>"


def word_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def shingle_sets(texts: pa.Array, size: int):
    """For each text the sorted distinct hashes of its shingles."""
    table, lower = word_table(), C.lower_table()
    for lo, hi in C.slices(texts):
        data, offsets = C.text_bytes(texts.slice(lo, hi - lo))
        data = lower[data]
        starts, ends, at = C.word_spans(data, offsets, table)
        words = C.span_hash(C.prefix_hash(data), starts, ends)
        grams = C.gram_hash(words, size)
        for k in range(hi - lo):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield C.gram_hash(words[a:b], b - a)
            else:
                yield np.zeros(0, C.U64)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = C.mix(np.arange(1, 2 * n + 1, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15))
    return x[:n] | C.U64(1), x[n:]


def minima_of(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash minima of each non-empty set, as rows."""
    mul, add = seeds(n)
    flat = np.concatenate(sets)
    flat ^= flat >> C.U64(29)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), C.U64)
    for k in range(n):
        x = flat * mul[k]
        x ^= x >> C.U64(32)
        x *= add[k] | C.U64(1)
        out[:, k] = np.minimum.reduceat(x, at)
    return out


def fingerprints(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits for each non-empty set."""
    flat = np.concatenate(sets)
    cuts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    count = np.array([len(s) for s in sets], C.U64)
    a = C.mix(np.add.reduceat(C.mix(flat), cuts) + count)
    b = C.mix(np.add.reduceat(C.mix(flat ^ C.BASES[1]), cuts) ^ (count * C.BASES[0]))
    return [row.tobytes() for row in np.stack([a, b], 1)]


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, size: int, subkeys: int, rows: int) -> DataFrame:
    def sign(batches):
        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(1)
            texts = C.as_texts(batch.column(2))
            for lo, hi in C.slices(texts, 1 << 20):
                sets = list(shingle_sets(texts.slice(lo, hi - lo), size))
                full = [k for k, s in enumerate(sets) if len(s)]
                names: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                if full:
                    own = [sets[k] for k in full]
                    minima = minima_of(own, 2 * subkeys * rows)
                    # a sub-key is `rows` minima, its place in the collections, and a mix of them
                    joined = C.mix(minima.reshape(len(own), 2 * subkeys, rows)[:, :, 0] + C.U64(1))
                    for r in range(1, rows):
                        joined = C.mix(joined * C.BASES[0] + minima.reshape(len(own), 2 * subkeys, rows)[:, :, r])
                    joined = C.mix(joined + np.arange(1, 2 * subkeys + 1, dtype=C.U64) * C.BASES[1]).view(np.int64)
                    name = fingerprints(own)
                    for j, k in enumerate(full):
                        names[k], keys[k] = name[j], joined[j]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), text_keys.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "class", "subkeys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(sign, SIGNED)


def full_sets(wanted: DataFrame, docs: DataFrame, signed: DataFrame, size: int) -> DataFrame:
    """The shingle set of each class in wanted(class), from the text of a document whose set it is."""

    def sets(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = list(shingle_sets(C.as_texts(batch.column(1)), size))
            rows = [(c, s.tobytes()) for c, s in zip(names, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["class", "set"])

    who = signed.join(wanted, "class", "left_semi").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("w")).select("class", F.col("w.doc_id").alias("_id"), F.col("w.text_key").alias("_key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_key().alias("_text"), "text")
    texts = who.join(rows, who["_id"].eqNullSafe(rows["_doc"]) & (who["_key"] == rows["_text"])).select("class", "text")
    return materialise(texts.mapInArrow(sets, "class binary, set binary").dropDuplicates(["class"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar."""

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, C.U64), np.frombuffer(y, C.U64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(similar, "a binary, b binary")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members(class, hub, ...) with n, of the hub n_hub, and the shingles added to and missing from the hub's."""

    def differ(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = np.frombuffer(x, C.U64), np.frombuffer(y, C.U64)
                out.append((len(x), len(y), np.setdiff1d(x, y, assume_unique=True).tobytes(), np.setdiff1d(y, x, assume_unique=True).tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], names=[*batch.schema.names[2:], "n", "n_hub", "added", "missing"])

    joined = members.join(sets.select("class", F.col("set").alias("_x")), "class").join(sets.select(F.col("class").alias("hub"), F.col("set").alias("_y")), "hub").select("_x", "_y", *members.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return joined.mapInArrow(differ, schema + ", n long, n_hub long, added binary, missing binary")


def links_within(table: pa.Table, percent: int) -> pa.Table:
    """Links between a hub's open members and its members of other components, one to a component."""
    names, roots, is_open = (table[c].to_pylist() for c in ("class", "root", "open"))
    added = [np.frombuffer(x, C.U64) for x in table["added"].to_pylist()]
    missing = [np.frombuffer(x, C.U64) for x in table["missing"].to_pylist()]
    n, n_hub = table["n"].to_numpy(), table["n_hub"].to_numpy()
    lacks = np.array([len(m) for m in missing])
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    part = np.array([number[r] for r in roots])

    def inverted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(lists)
        order = np.argsort(flat, kind="stable")
        return flat[order], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]

    (add_keys, add_who), (miss_keys, miss_who) = inverted(added), inverted(missing)

    found = []
    for i in np.flatnonzero(is_open):
        of_hub = n_hub[i] - lacks[i]
        lo, hi = np.searchsorted(add_keys, added[i], "left"), np.searchsorted(add_keys, added[i], "right")
        if of_hub * 100 < percent * n[i]:
            need = -(-percent * n[i] // 100) - of_hub  # added shingles that a similar text shares at least
            rare = np.argsort(hi - lo, kind="stable")[: max(0, len(added[i]) - need + 1)]
            who = np.unique(np.concatenate([add_who[lo[k] : hi[k]] for k in rare] or [np.zeros(0, np.int64)]))
        else:
            who = np.arange(len(names))
        who = who[(part[who] != part[i]) & (np.minimum(n[who], n[i]) * 100 >= percent * np.maximum(n[who], n[i]))]
        if not len(who):
            continue
        overlap = np.zeros(len(names), np.int64)
        for k in range(len(lo)):
            overlap[add_who[lo[k] : hi[k]]] += 1
        lo, hi = np.searchsorted(miss_keys, missing[i], "left"), np.searchsorted(miss_keys, missing[i], "right")
        for k in range(len(lo)):
            overlap[miss_who[lo[k] : hi[k]]] += 1
        common = n_hub[i] - lacks[i] - lacks[who] + overlap[who]
        who = who[100 * common >= percent * (n[i] + n[who] - common)]
        _, first = np.unique(part[who], return_index=True)
        found += [(names[i], names[k]) for k in who[first]]
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): node, root (the smallest node in it).

    Alternating large-star and small-star steps: every node is tied to the smallest node
    known in its neighbourhood, until nothing changes any more, which takes a logarithmic
    number of rounds. Aggregates and equi-joins only; a hub's edges are split like those of
    any join key. A round's table goes once the next one is written. A round never has more
    edges than it was given, so that few edges are a few files, however many partitions a
    shuffle has: each file that a task writes costs processes for its permissions."""
    files = max(1, -(-edges.count() // FILE_EDGES))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        tied = both.join(least, "a")
        if large:
            return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files), "edges")
    before, settled = state(now), False
    while before[0] and not settled:
        then, now = now, materialise(star(star(now, True), False).coalesce(files), "edges")
        after = state(now)
        settled, before = after == before, after
        drop_materialised(then)
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").coalesce(files)


def grouped(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR_PERCENT, subkeys: int = SUBKEYS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, text_key, n_shingles, and root, which rows of one group share (null: no shingles)."""
    C.ship(docs.sparkSession)
    signed = materialise(signatures(docs, size, subkeys, rows), "signatures")
    classes = signed.filter("class is not null").groupBy("class").agg(F.min("subkeys").alias("subkeys"))
    classes = materialise(classes, "classes")

    own = classes.select("class", F.posexplode("subkeys").alias("place", "subkey"))
    shared = own.groupBy("subkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = F.col("place") < subkeys
    sides = own.join(shared, "subkey").groupBy("class").agg(F.collect_list(F.when(first, F.col("subkey"))).alias("u"), F.collect_list(F.when(~first, F.col("subkey"))).alias("v"), F.sum("n").alias("shares")).filter("size(u) > 0 and size(v) > 0")
    keys = sides.select("class", "shares", F.explode("u").alias("u"), "v").select("class", "shares", "u", F.explode("v").alias("v"))
    keys = materialise(keys.select(F.xxhash64("u", "v").alias("key"), "class", "shares"), "keys")

    hubs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("shares", "class")).alias("hub")).filter("n > 1").select("key", F.col("hub.class").alias("hub"))
    members = materialise(keys.join(hubs, "key").filter(F.col("class") != F.col("hub")).select("class", "hub").distinct(), "members")
    pairs = members.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    sets = full_sets(members.select("class").unionByName(members.select(F.col("hub").alias("class"))).distinct(), docs, signed, size)
    links = materialise(verified(pairs, sets, percent), "links")
    roots = materialise(components(links), "roots")

    # step 5: members in other components than their hubs
    placed = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = placed.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    placed = placed.withColumn("open", F.col("root") != F.coalesce("hub_root", "hub")).select("class", "hub", "root", "open")
    groups = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("_n"), F.count_if("open").alias("_open")).filter("_open > 0 and _n > 1").select("hub", F.ceil(F.col("_n") / chunk).cast("int").alias("chunks"))
    differing = materialise(differences(placed.join(groups, "hub").select("class", "hub", "root", "open", "chunks"), sets), "differences")
    own_chunk = F.array(F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    dealt = differing.withColumn("chunk", F.explode(F.when(F.col("open"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own_chunk))).drop("chunks")
    more = materialise(dealt.groupBy("hub", "chunk").applyInArrow(lambda table: links_within(table, percent), "a binary, b binary"), "more")
    if not more.isEmpty():
        roots = materialise(components(links.unionByName(more)), "roots")

    named = classes.select("class").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lone = signed.filter("class is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("binary").alias("root"))
    return signed.filter("class is not null").select("doc_id", "text_key", "n_shingles", "class").join(named, "class").select("doc_id", "text_key", "n_shingles", "root").unionByName(lone)


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows = materialise(grouped(docs, **parameters), "grouped")
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = rows.filter("root is not null").join(least, "root").select("doc_id", "n_shingles", "component_id")
    lone = rows.filter("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def distinct_documents(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each group of near-duplicates, as it is, and all rows without shingles.

    It is a row with the group's smallest doc_id (a null one comes last) and, where rows of
    the group share that id, the text with the smallest md5; of rows that are equal in both
    any one stays. A row of another group stays, whatever its doc_id."""
    groups = grouped(docs, **parameters).filter("root is not null")
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.text_key").alias("_key"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_key().alias("_text"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("_words"))
    found = rows.filter("_words").join(chosen, rows["_doc"].eqNullSafe(chosen["_id"]) & (rows["_text"] == chosen["_key"]))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("_doc", "_text").orderBy(F.lit(0)))).filter("_n = 1")
    return first.select("_row.*").unionByName(rows.filter(~F.col("_words")).select("_row.*"))
