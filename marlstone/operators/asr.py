"""Transcripts against reference texts and expected terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import word_error_rate

FALLBACK = "fallback-reference"


def with_reference(transcripts: DataFrame, references: DataFrame, plain: str = "prototype", voiced: str = "voicemod") -> DataFrame:
    """transcripts(path, text, ...) with query, speaker, and the reference of the set that the file's name
    points to: references(dataset, query, reference). Transcripts without one stay, with a null reference."""
    query, speaker = T.audio_name(F.col("path"))
    named = transcripts.withColumns({"query": query, "speaker": speaker})
    named = named.withColumn("dataset", F.when(F.col("speaker") == "original", plain).otherwise(voiced))
    return named.join(references.select("dataset", "query", "reference"), ["dataset", "query"], "left")


def with_fallback(transcribed: DataFrame, allow: bool = False) -> DataFrame:
    """Where no transcript was made, the reference stands in if that is allowed, and is stamped as such: adds model."""
    lost = F.col("text").isNull() & F.lit(allow) & F.col("reference").isNotNull()
    return transcribed.withColumn("model", F.when(lost, FALLBACK).when(F.col("text").isNotNull(), "asr")).withColumn("text", F.when(lost, F.col("reference")).otherwise(F.col("text")))


def with_error_rate(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("wer", word_error_rate(T.spoken_normal(F.col("reference")), T.spoken_normal(F.col("text"))))


def term_hits(transcripts: DataFrame, terms: DataFrame) -> DataFrame:
    """Each transcript's expected terms, and whether its text has them: transcripts(query, text, ...), terms(query, term).

    A query's terms come as one array, so that a transcript is normalised once."""
    meant = terms.select("query", F.struct("term", T.spoken_normal(F.col("term")).alias("form")).alias("t")).groupBy("query").agg(F.collect_list("t").alias("_terms"))
    found = T.bound(T.spoken_normal(F.col("text")), lambda said: F.transform("_terms", lambda t: F.struct(t["term"].alias("term"), F.contains(said, t["form"]).alias("recognized"))))
    return transcripts.join(meant, "query").select(*transcripts.columns, F.inline(found))


def accuracy(hits: DataFrame, *by: str) -> DataFrame:
    """Share of recognised terms, over all or by columns."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("recognized").cast("double")), 6).alias("accuracy"))


def misses(hits: DataFrame, by: str) -> DataFrame:
    return hits.filter(~F.col("recognized")).groupBy(by).agg(F.count(F.lit(1)).alias("misses"))


def mean_error_rate(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("wer").alias("n"), F.round(F.avg("wer"), 6).alias("wer"))


def changed(inputs: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """Whether a key's input differs from the one before, by its SHA-256: adds fingerprint and changed."""
    from pyspark.sql import Window

    rows = inputs.withColumn("fingerprint", F.sha2(content.cast("binary"), 256))
    before = F.lag("fingerprint").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("changed", before.isNull() | (before != F.col("fingerprint")))
