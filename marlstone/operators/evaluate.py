"""Retrieval metrics, word error rate, and answer invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Recall (null without relevant documents), precision at k, reciprocal rank and nDCG of each query.

    ranked(qid, doc_id, rank), relevant(qid, doc_id), queries(qid)."""
    truth = relevant.select("qid", "doc_id").distinct()
    size = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.filter(F.col("rank") <= k).join(truth, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    rows = queries.select("qid").join(size, "qid", "left").join(hits, "qid", "left")
    found = F.coalesce("hits", F.lit(0))
    return rows.select(
        "qid", F.round(found / F.col("n"), 6).alias("recall"), F.round(found / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(F.lit(0.0)), 6).alias("ndcg"),
    )


def known_relevant(relevant: DataFrame, catalogue: DataFrame, key: str = "doc_id") -> DataFrame:
    """Judgements whose document the catalogue has: a slip in the gold set doesn't count against recall."""
    return relevant.join(catalogue.select(key).distinct(), key, "left_semi").select(*relevant.columns)


def honored(found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whether each query's results keep its price and rating filters: found(qid, price, rating, filters).

    A missing value fails a filter on it; other filters are not checked."""
    f = F.col("filters")
    kept = lambda asked, test: asked.isNull() | F.coalesce(test, F.lit(False))
    ok = kept(f["price_max"], F.col("price") <= f["price_max"] + tolerance) & kept(f["price_min"], F.col("price") >= f["price_min"] - tolerance) & kept(f["min_rating"], F.col("rating") >= f["min_rating"] - tolerance)
    return found.groupBy("qid").agg(F.bool_and(f.isNull() | ok).alias("honored"))


def case_summary(cases: DataFrame) -> DataFrame:
    """Of cases(messages array, wall_ms): how many, passed, failed, and the mean time."""
    failed = F.count_if(F.size("messages") > 0)
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), (F.count(F.lit(1)) - failed).alias("n_passed"), failed.alias("n_failed"), F.coalesce(F.round(F.avg("wall_ms")), F.lit(0.0)).cast("long").alias("mean_wall_ms"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means; undefined recalls are left aside."""
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


def as_characters(words: Column, vocabulary: Column) -> Column:
    """A text in which each word is one character: the word's place in the vocabulary, beyond the first plane, in UTF-8."""

    def in_hex(word: Column) -> Column:
        n = (F.array_position(vocabulary, word) + 0xFFFF).cast("long")
        six = lambda bits: F.shiftright(n, bits).bitwiseAND(63)
        return F.hex(F.lit(0xF0808080) + F.shiftleft(F.shiftright(n, 18), 24) + F.shiftleft(six(12), 16) + F.shiftleft(six(6), 8) + six(0))

    return F.decode(F.unhex(F.array_join(F.transform(words, in_hex), "")), "UTF-8")


def word_edits(reference: Column, spoken: Column) -> Column:
    """Edit distance of two arrays of words: of two texts over an alphabet made for the pair, a character for
    each of its distinct words (a million at most)."""
    pair = F.struct(reference.alias("a"), spoken.alias("b"), F.array_distinct(F.concat(reference, spoken)).alias("v"))
    bound = F.transform(F.array(pair), lambda p: F.levenshtein(as_characters(p["a"], p["v"]), as_characters(p["b"], p["v"])))
    return F.get(bound, F.lit(0))


def word_error_rate(reference: Column, spoken: Column) -> Column:
    """Word edit distance over the reference's length, of normalised texts; null texts are empty."""
    words = lambda text: F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    pair = F.transform(F.array(F.struct(words(reference).alias("a"), words(spoken).alias("b"))), lambda p: F.when(F.size(p["a"]) > 0, word_edits(p["a"], p["b"]) / F.size(p["a"])).otherwise((F.size(p["b"]) > 0).cast("double")))
    return F.get(pair, F.lit(0))


def invariants(speech_seconds: Column, action: Column, uncited: Column, steps: Column, flagged: Column, budget: float = 15.0, spoken: Column | None = None, audio: Column | None = None) -> Column:
    """Messages on what is wrong with an answered turn; none if all is well.

    spoken says whether audio was made, audio whether its file is there."""
    ok = action.isin("accept", "revise") | ((action == "reject") & flagged)
    spoken, audio = F.lit(False) if spoken is None else spoken, F.lit(True) if audio is None else audio
    return F.array_compact(F.array(
        F.when(speech_seconds <= 0, "no speech"), F.when(speech_seconds > budget, "over budget"), F.when(~ok, "bad action"),
        F.when(uncited > 0, "uncited row"), F.when(steps == 0, "no steps"), F.when(spoken & (action != "accept"), "spoken before accept"), F.when(spoken & ~audio, "no audio file"),
    ))
