"""Quality rules: base counts of a text, and its divergence from its language's references.

All on the JVM. A first pass over all documents builds the references: for each known
language the mean histogram over character classes and over the language's most common
words (and the rest), from the texts that are long enough. At most one row for each
known language and one for all others reaches the driver. The second pass is a single
projection: base counts, the Jensen-Shannon distances (base 2, so 0 to 1) of the text's
own histograms from the references, and the verdict. Nothing is shuffled.

A text fails the method if either distance is above its bound; below MIN_WORDS words the
histograms say little, and the text passes. In an unknown language only character
classes count.

Edge cases: a null text has no words; a null language is unknown; a language without a
long enough text has no reference and rejects nothing; repeated rows are each judged;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.3
# Calibrated on labels, on the even document ids of sf0.1: the largest bound (in steps of 0.01) that
# rejects 98 % of each kind of labelled junk. The README has the held-out figures.
MAX_WORD_DISTANCE = 0.26
SPACE = r"[\x20\x09-\x0D]"
# Common words of each language.
COMMON = {
    "en": "the of and to in is that for with as was on are by this be it from or a",
    "fr": "de la le et les des en un une du que est pour qui dans sur pas au par avec",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als es",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": r"#*$%&|<>", "mark": r"\p{P}\p{S}", "space": r"\s"}


def spaced_words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def count_of(text: Column, inside: str) -> Column:
    """How many code points of a text lie in a class of characters."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words within some 5-word window that occurs twice or more in the text."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))

    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return (
            F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long"))
            .otherwise(bound(ranked, lambda r: bound(F.sort_array(F.transform(F.filter(r, lambda x, k: ((k > 0) & (F.get(r, k - 1)["g"] == x["g"])) | F.coalesce(F.get(r, k + 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])), union_of_windows)))
        )

    return F.when(n < 6, F.lit(0).cast("long")).otherwise(bound(grams, covered))


def union_of_windows(at: Column) -> Column:
    """Length of the union of the windows [p, p + 5) over sorted positions."""
    return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def bound(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with _text, _words and _language."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.col("lang").cast("string")
    return docs.withColumns({"_text": text, "_language": F.when(known.isin(*COMMON), known).otherwise(F.lit("other"))}).withColumn("_words", spaced_words(F.col("_text")))


def class_counts() -> Column:
    text = F.col("_text")
    upper, digit, symbol, marks, space = (count_of(text, x) for x in CLASSES.values())
    return F.array(upper, digit, symbol, marks, space, F.length(text).cast("long"))


def class_histogram(counts: Column) -> Column:
    """Shares of upper case, digits, symbols, other marks, white space, and the rest; symbols are marks too."""
    u, d, s, m, w, n = (F.get(counts, F.lit(k)) for k in range(6))
    return F.array(*[x / F.greatest(n, F.lit(1)) for x in (u, d, s, m - s, w, n - u - d - m - w)])


def word_histogram(words: Column, language: Column) -> Column:
    """Shares of the language's common words (any case, marks around them cut off), and of the rest."""
    width = max(len(x.split()) for x in COMMON.values())
    table = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    own = F.coalesce(F.try_element_at(table, language), F.array().cast("array<string>"))

    def shares(own: Column) -> Column:
        places = F.filter(F.transform(words, lambda w: F.array_position(own, F.lower(F.rtrim(w, F.lit(".,;:!?"))))), lambda p: p > 0)
        n = F.greatest(F.size(words), F.lit(1))
        return bound(places, lambda p: F.concat(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.size(F.filter(p, lambda x: x == k)) / n), F.array((F.size(words) - F.size(p)) / n)))

    return bound(own, shares)


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram from a reference."""

    def part(x: Column, y: Column) -> Column:
        middle = (x + y) / 2
        term = lambda v: F.when(v > 0, v * F.log2(v / middle)).otherwise(F.lit(0.0))
        return (term(x) + term(y)) / 2

    total = F.aggregate(F.zip_with(p, F.array(*map(F.lit, q)), part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(docs: DataFrame, min_words: int = MIN_WORDS) -> dict[str, tuple[list[float], list[float]]]:
    """For each known language (and `other`) the mean histograms over its long enough texts."""
    rows = with_counts(docs.select("text", "lang")).filter(F.size("_words") >= min_words)
    rows = rows.select("_language", class_histogram(class_counts()).alias("c"), word_histogram(F.col("_words"), F.col("_language")).alias("w"))
    n_words = max(len(x.split()) for x in COMMON.values()) + 1
    # sums of whole numbers don't depend on the order of rows
    whole = lambda column, k: F.sum(F.round(F.get(column, F.lit(k)) * 1e9).cast("long"))
    sums = rows.groupBy("_language").agg(F.count(F.lit(1)).alias("n"), F.array(*[whole("c", k) for k in range(6)]).alias("c"), F.array(*[whole("w", k) for k in range(n_words)]).alias("w"))
    return {r["_language"]: ([x / r["n"] / 1e9 for x in r["c"]], [x / r["n"] / 1e9 for x in r["w"]]) for r in sums.collect()}


def judged(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]] | None = None, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs with the base counts, class_distance, word_distance (null without reference) and kept."""
    refs = references(docs, min_words) if refs is None else refs
    rows = with_counts(docs)
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", SPACE + "+", "")).cast("long"),
        "_classes": class_counts(),
        "_shares": word_histogram(F.col("_words"), F.col("_language")),
        "n_dup_lines": bound(F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != ""), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(F.col("_words")),
    })
    far = {"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")}
    for language, (classes, words) in sorted(refs.items()):
        own = F.col("_language") == language
        far["class_distance"] = F.when(own, distance(class_histogram(F.col("_classes")), classes)).otherwise(far["class_distance"])
        if language in COMMON:
            far["word_distance"] = F.when(own, distance(F.col("_shares"), words)).otherwise(far["word_distance"])
    rows = rows.withColumns({"n_symbols": F.get("_classes", F.lit(2)), "base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)} | far)
    bad = (F.col("n_words") >= min_words) & (F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_text", "_words", "_language", "_classes", "_shares")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): base counts, distances and verdict."""
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")).select("doc_id", *COUNTS, F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, as they are.

    Verdicts are written beside their rows before rows are chosen: a filter on the verdict
    would be moved below the counts, and count again for each use."""
    rows = judged(docs.select(F.struct("*").alias("_own"), "text", "lang"))
    return materialise(rows.select("_own", "kept"), "judged", compression="zstd").filter("kept").select("_own.*")
