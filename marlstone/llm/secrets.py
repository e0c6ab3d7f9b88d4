"""Secret scanning: base patterns, and a pair of character Markov models. All on the JVM.

Base patterns are matched leftmost and non-overlapping for each kind, and matches that
are too short are dropped. The method adds spans of the kind `markov`: runs of
token characters whose characters follow each other as in random strings rather than as
in identifiers and words. Two first-order models over the 67 token characters (capitals,
small letters, digits and marks each by itself) are trained from labelled samples that
this module generates: SAMPLES random strings in several encodings, and SAMPLES names,
words, paths, dates and numbers in several styles. Base spans are cut out of the text.
Every run of MIN_RUN or more token characters in what is left is scored, whatever it is
made of, and is flagged whole if any of these has MIN_RUN characters or more and a mean
log-likelihood ratio above THRESHOLD: itself, a part between separators, or the up to
WINDOW characters behind a separator. So a secret is not averaged away by the text that
it is glued to.

Offsets come from the pieces between matches: a match starts where the pieces and
matches before it end. Offsets are in code points; each span also has its place in
bytes, by which texts are cut in one step. Sums along a text's matches are taken in
blocks of BLOCK, so that the work grows with the text and not with its square.

Edge cases: a null text is empty and has no spans; repeated rows are each reported;
other columns are ignored by the scan and kept by the masking, whatever their names; an
empty table gives no rows; a text may be one run of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns. Letters of the keywords are in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so this is [0-9a-f]+ with the short ones dropped
RUN = r"[A-Za-z0-9+/=_-]{20,}"
SEPARATORS = r"[+/=_-]+"
WINDOW = 64
BEHIND = r"(?<=[+/=_-])(?=([A-Za-z0-9][A-Za-z0-9+/=_-]{19,63}))"  # MIN_RUN to WINDOW characters
MIN_ASSIGNED, MIN_ACCESS, MIN_RUN = 12, 18, 20
KINDS = ("assign", "access", "hex", "markov")

SAMPLES = 6000
SMOOTHING = {True: 8.0, False: 40.0}  # of random strings, of names: names of other make than the samples are common
MOST = 3.0
THRESHOLD = 0.4
BLOCK = 128
UPPER, LOWER, DIGITS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/=_-"
ALPHABET = UPPER + LOWER + DIGITS + MARKS
CODES = [max(ALPHABET.find(chr(k)), 0) for k in range(128)]
NAMES = (
    "get set list item user name value index count table column row key map array string number file path read write open close "
    "start stop first last next prev data base cache store load save update delete insert select query result error message handler "
    "request response client server session connect timeout retry batch stream event queue worker thread process task schedule time "
    "date format parse render template view model controller service config option default test check valid build make create new old "
    "max min size length width height color image text font page link button form input output log level debug info warn trace public "
    "private static final class method function return type object node tree graph edge parent child root leaf left right top bottom "
    "src cfg tmp cmd std str fmt msg btn idx len ptr ctx xml html json url http https sql css jpg pdf api sdk cpu gpu ssl tcp dns md5 sha256 "
    "base64 utf16 x86 v1 v2 mp3 h264 i18n l10n ipv4 ipv6 p99 s3 k8s step1 phase2 level3 test01 row10 max100 rgb24 crc32 int64 float32"
)
WORDS = (
    "the people water should another through thought children following important government development sometimes nothing between "
    "world country question working history understand information together remember business company against during without however "
    "under possible different within together language system program interest national experience education community individual "
    "der die nicht werden zwischen gesellschaft entwicklung verschiedene moeglichkeit wissenschaft geschichte bereich zeit menschen "
    "einheit freundlich schreiben durch gegen verantwortung arbeit wirtschaft sprache schule pflicht heitlich unter ueber einschliesslich "
    "dans pour avec tout mais comme faire entre toujours pendant question gouvernement developpement histoire travail beaucoup maintenant "
    "nouveau quelque personne politique economique connaissance que les des cette aussi ouvrir langue heureux cependant eaux tion "
    "para como pero entre cuando tiempo trabajo gobierno desarrollo historia siempre persona mientras porque tambien nuestro ciudad "
    "pregunta conocimiento educacion lengua amigo mundo ciones importante manera segundo despues hacia encuentra"
)
SPAN = "struct<kind:int,start:int,end:int,from:int,to:int>"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def folded(items: Column, state: Column, out_type: str, step: Callable, emit: Callable) -> Column:
    """[emit(state before, x) for x in items], the state following by step(state, x)."""
    empty, none = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def one(a: Column, x: Column) -> Column:
        return F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(emit(a["s"], x))).alias("out"))

    def block(a: Column, xs: Column) -> Column:
        return bound(F.aggregate(xs, F.struct(a["s"].alias("s"), empty.alias("out")), one), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    return F.flatten(F.aggregate(blocks, F.struct(state.alias("s"), none.alias("out")), block, lambda a: a["out"]))


def spans_of(text: Column, pattern: str, kind: int, enough, group: int = 0) -> Column:
    """Spans of a pattern's matches for which enough(match, group) holds, in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("match"), groups.alias("own"))
    sized = F.transform(parts, lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.octet_length(x["piece"]).alias("gap_b"), F.length(x["match"]).alias("n"), F.octet_length(x["match"]).alias("n_b"), F.coalesce(enough(x["match"], x["own"]), F.lit(False)).alias("good")))
    sized = F.filter(sized, lambda x: x["n"].isNotNull())  # behind the last match there is a piece only
    found = bound(sized, lambda xs: folded(
        xs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("at_b")), SPAN,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), (s["at_b"] + x["gap_b"] + x["n_b"]).alias("at_b")),
        lambda s, x: F.when(x["good"], F.struct(F.lit(kind).alias("kind"), (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), (s["at_b"] + x["gap_b"]).alias("from"), (s["at_b"] + x["gap_b"] + x["n_b"]).alias("to"))),
    ))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


# -- the models ---------------------------------------------------------------------


def drawn(alphabet: str, length: int | Column, salt: int) -> Column:
    """A random string that hangs on the row's id alone."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))), "")


def in_turn(cases: list[Column]) -> Column:
    out = F.lit(None).cast("string")
    for k, case in enumerate(cases):
        out = F.when(F.col("id") % len(cases) == k, case).otherwise(out)
    return out


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled samples: text, random (boolean). Generated by rule, the same each time."""
    ids = spark.range(n)
    hexed = lambda k, size: drawn("0123456789abcdef", size, k)
    shapes = [
        drawn(UPPER + LOWER + DIGITS, 32, 1), F.concat(drawn(UPPER + LOWER + DIGITS + "+/", 42, 2), F.lit("==")), drawn(UPPER + LOWER + DIGITS + "-_", 43, 3), hexed(4, 40),
        drawn(LOWER + DIGITS, 32, 5), drawn(LOWER, 28, 6), drawn(UPPER + "234567", 32, 7), drawn(UPPER + LOWER, 28, 8), drawn(UPPER, 28, 9),
        F.concat_ws("-", hexed(10, 8), hexed(11, 4), hexed(12, 4), hexed(13, 4), hexed(14, 12)),
    ]
    strings = ids.select(in_turn(shapes).alias("text"), F.lit(True).alias("random"))
    pick = lambda table, k: F.get(F.array(*map(F.lit, table.split())), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(table.split()))).cast("int"))
    parts, plain = [pick(NAMES, k) for k in range(4)], [pick(WORDS, k) for k in range(20, 24)]
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100)).cast("string")
    two = lambda k: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(60)).cast("string"), 2, "0")
    styles = [
        F.concat_ws("_", *parts), F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat_ws("-", *parts), F.concat_ws("/", *parts), F.upper(F.concat_ws("_", *parts)),
        F.concat(F.concat_ws("_", *parts), F.lit("_"), number), F.concat(*[F.initcap(p) for p in parts]), F.concat(*plain), F.initcap(F.concat(*plain)), F.upper(F.concat(*plain)), F.concat_ws("-", *plain),
        F.concat(F.lit("20"), two(30), F.lit("-"), two(31), F.lit("-"), two(32), F.lit("T"), two(33), F.lit("-"), two(34), F.lit("-"), two(35), F.lit("-"), parts[0]), drawn(DIGITS, 24, 36),
        F.repeat(F.substring(F.lit("-=_+/"), F.pmod(F.xxhash64("id", F.lit(37)), F.lit(5)).cast("int") + 1, F.lit(1)), F.lit(24)), F.concat(F.concat_ws("/", *plain), F.lit("/"), number, F.lit("/"), parts[1], F.lit("="), number),
    ]
    names = ids.select(in_turn(styles).alias("text"), F.lit(False).alias("random"))
    return strings.unionByName(names)


def train(labelled: DataFrame, smoothing: dict[bool, float] = SMOOTHING, most: float = MOST) -> list[float]:
    """Log-likelihood ratios of character pairs (random over name), row by row of ALPHABET.

    Pair counts are taken over all labelled rows; at most two tables of that size return.
    A pair's share is drawn towards that of the two characters' kinds, and no single pair
    says more than `most` either way."""
    pairs = labelled.filter(F.length("text") >= 2).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = (UPPER, LOWER, DIGITS, MARKS)

    def shares(random: bool) -> list[list[float]]:
        out = []
        for kind in kinds:
            whole = [sum(counts.get((random, a + b), 0) for a in kind for b in other) for other in kinds]
            prior = [(w + 1) / (sum(whole) + len(kinds)) / len(other) for w, other in zip(whole, kinds, strict=True) for _ in other]
            for a in kind:
                own = [counts.get((random, a + b), 0) for b in ALPHABET]
                out.append([(n + smoothing[random] * p) / (sum(own) + smoothing[random]) for n, p in zip(own, prior, strict=True)])
        return out

    return [round(max(-most, min(most, math.log(p / q))), 6) for ps, qs in zip(shares(True), shares(False), strict=True) for p, q in zip(ps, qs, strict=True)]


def mean_ratio(run: Column, table: list[float]) -> Column:
    codes, ratios = F.lit(CODES), F.lit([float(x) for x in table])
    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.get(codes, F.ascii(c)))

    def total(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
        ratio = lambda a, x: F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(ratios, a["last"] * len(ALPHABET) + x), F.lit(0.0)))
        return F.aggregate(p, start, lambda a, x: F.struct((a["sum"] + ratio(a, x)).alias("sum"), x.alias("last")), lambda a: a["sum"]) / F.greatest(F.size(p) - 1, F.lit(1))

    return bound(places, total)


def suspicious(run: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """Whether a run, a part of it between separators, or what follows a separator looks random."""
    parts = F.concat(F.array(run), F.split(run, SEPARATORS), F.regexp_extract_all(run, F.lit(BEHIND), F.lit(1)))
    return F.exists(F.filter(F.array_distinct(parts), lambda x: F.length(x) >= MIN_RUN), lambda x: mean_ratio(x, table) > threshold)


def by_start(spans: Column) -> Column:
    moved = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to")))
    return F.transform(F.array_sort(moved), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to")))


def pieces_between(text: Column, spans: Column) -> Column:
    """The pieces of a text before, between and behind sorted spans, some maybe empty: start (in code points), piece."""
    items = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to"))), F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.octet_length(text).alias("from"), F.octet_length(text).alias("to"))))
    cut = bound(items, lambda xs: folded(
        xs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("at_b")), "struct<start:int,from:int,to:int>",
        lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.greatest(s["at_b"], x["to"]).alias("at_b")),
        lambda s, x: F.struct(s["at"].alias("start"), s["at_b"].alias("from"), x["from"].alias("to")),
    ))
    piece = lambda raw, x: F.struct(x["start"].alias("start"), x["from"].alias("from"), F.substring(raw, x["from"] + 1, x["to"] - x["from"]).cast("string").alias("piece"))
    return bound(text.cast("binary"), lambda raw: F.transform(F.filter(cut, lambda x: x["from"] <= x["to"]), lambda x: piece(raw, x)))


def with_spans(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with _base and _spans: arrays of (kind, start, end, from, to) by start, then kind."""
    table = train(samples(docs.sparkSession)) if table is None else table
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        spans_of(text, ASSIGN, 0, lambda m, g: F.length(g) >= MIN_ASSIGNED, 2),
        spans_of(text, ACCESS, 1, lambda m, g: F.length(m) >= MIN_ACCESS),
        spans_of(text, HEX, 2, lambda m, g: F.length(m) >= 16),
    )

    def flagged(piece: Column, at: Column, at_b: Column) -> Column:
        runs = spans_of(piece, RUN, 3, lambda m, g: suspicious(m, table, threshold))
        return F.transform(runs, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), (s["from"] + at_b).alias("from"), (s["to"] + at_b).alias("to")))

    # where base spans are, each piece between them is looked at by itself; bytes before a piece are those of the text before it
    cut = F.flatten(F.transform(pieces_between(text, F.col("_base")), lambda p: flagged(p["piece"], p["start"], p["from"])))
    added = F.when(F.regexp_like(text, F.lit(RUN)), F.when(F.size("_base") == 0, spans_of(text, RUN, 3, lambda m, g: suspicious(m, table, threshold))).otherwise(cut)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return docs.withColumn("_base", by_start(base)).withColumn("_spans", by_start(F.concat("_base", added)))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): counts and digest of the base spans, and all spans."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def masked_text(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans replaced by a mask."""
    # between spans that touch there is an empty piece, which makes no mask of its own
    inner = bound(pieces_between(text, spans), lambda pieces: bound(F.size(pieces) - 1, lambda last: F.filter(F.transform(pieces, lambda x: x["piece"]), lambda p, k: (k == 0) | (k == last) | (p != ""))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(inner, mask))


def masked(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text, and n_chars (where there is one) following it."""
    columns = docs.columns
    rows = with_spans(docs.select(F.struct("*").alias("_own"), F.col("text").alias("text")))
    rows = rows.withColumn("_masked", F.when(F.size("_spans") > 0, masked_text(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
    own = {c: F.col("_own")[c] for c in columns}
    own["text"] = F.col("_masked")
    if "n_chars" in columns:
        own["n_chars"] = F.when(F.size("_spans") > 0, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[own[c].alias(c) for c in columns])
