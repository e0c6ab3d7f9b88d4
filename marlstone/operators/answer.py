"""Spoken answers, citations and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import SPEECH_SECONDS, money, speech_seconds, truncate_to_budget

NOTHING = "No matching product was found in the catalog, so there is no grounded recommendation."
CAUTION = "Caution: never mix these products. "


def by_turn(*order: str) -> WindowSpec:
    return Window.partitionBy("qid").orderBy(*order)


def merge_citations(cited: DataFrame) -> DataFrame:
    """The first of equal citations (qid, doc_id, url), in the order of ord: cited(qid, source, doc_id, url, ord)."""
    same = Window.partitionBy("qid", "doc_id", "url").orderBy("ord")
    once = cited.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return once.select("qid", "source", "doc_id", "url", F.row_number().over(Window.partitionBy("qid").orderBy("ord")).cast("long").alias("place"))


def spoken_answer(title: Column, price: Column, rating: Column, alternatives: Column, seconds: float = SPEECH_SECONDS) -> Column:
    """The pick in one sentence, with as many further clauses as can be said in time."""
    out = F.concat(F.lit("The best match is "), title, F.lit(" at "), F.coalesce(money(price), F.lit("an unlisted price")), F.coalesce(F.concat(F.lit(", rated "), rating.cast("string")), F.lit("")), F.lit("."))
    clauses = [F.concat(F.lit(" It was compared with "), alternatives.cast("string"), F.lit(" others.")), F.lit(" Sources are on screen."), F.lit(" Should it be cheaper, or better rated?")]
    for c in clauses:
        longer = F.concat(out, c)
        out = F.when(speech_seconds(longer) <= seconds, longer).otherwise(out)
    return F.when(title.isNull(), NOTHING).when(speech_seconds(out) > seconds, truncate_to_budget(out, seconds)).otherwise(out)


def verdict(blocked: Column, ungrounded: Column, hazards: Column, revisions: Column, most: int = 1) -> Column:
    """reject for blocked turns, revise for ungrounded ones up to the bound, else accept; hazards alone don't change it."""
    return F.when(blocked, "reject").when((ungrounded > 0) & (revisions < most), "revise").otherwise("accept")


def cautioned(speech: Column, hazards: Column) -> Column:
    return F.when(F.size(hazards) > 0, F.concat(F.lit(CAUTION), speech)).otherwise(speech)


def trace(steps: DataFrame) -> DataFrame:
    """Each trace's steps in order, their number and total time: steps(trace_id, step, node, elapsed_ms)."""
    held = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step", "node", "elapsed_ms"))).alias("steps"), F.sum("elapsed_ms").alias("total_ms"))
    return held.select("trace_id", F.size("steps").cast("long").alias("n_steps"), "total_ms", F.array_join(F.col("steps.node"), " > ").alias("path"))
