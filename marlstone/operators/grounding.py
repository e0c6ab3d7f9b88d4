"""Sources of grounded answers: which pages an answer rests on, and which of its sentences rest on them.

An answer comes as one row: answers(request_id, answer, chunks, supports), with chunks
array<struct<uri, title>> the pages found, and supports array<struct<text, refs>> parts of the
answer with the places of the sources that back them. Everything stays within the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..session import materialise

# The longest snippets of sources and of bare answers, and their scores.
SNIPPET, BARE_SNIPPET, SCORE, BARE_SCORE = 200, 500, 0.75, 0.7
SOURCE = "array<struct<title:string,url:string,snippet:string,score:double,answer:string>>"


def sources_of(answer: Column, chunks: Column, supports: Column, most: int, bare_title: str = "Answer") -> Column:
    """The distinct chunks in their order, up to `most`, each with the first part of the answer that refers to its
    place among them; the first one carries the whole answer. An answer without chunks is a source by itself."""
    named = F.filter(F.coalesce(chunks, F.array().cast("array<struct<uri:string,title:string>>")), lambda c: F.coalesce(c["uri"], F.lit("")) != "")
    uris = F.transform(named, lambda c: c["uri"])
    once = bound(F.struct(named.alias("c"), uris.alias("u")), lambda p: F.filter(p["c"], lambda c, k: F.array_position(p["u"], c["uri"]) == k + 1))
    said = F.filter(F.coalesce(supports, F.array().cast("array<struct<text:string,refs:array<int>>>")), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    told = F.coalesce(answer, F.lit(""))

    def with_snippets(pair: Column) -> Column:
        backing = lambda place: F.get(F.filter(pair["s"], lambda s: F.coalesce(F.array_contains(s["refs"], place), F.lit(False))), F.lit(0))["text"]
        row = lambda c, k: F.struct(F.coalesce(c["title"], F.lit("")).alias("title"), c["uri"].alias("url"), F.coalesce(F.substring(backing(k), 1, SNIPPET), F.lit("")).alias("snippet"), F.lit(SCORE).alias("score"), F.when(k == 0, told).alias("answer"))
        return F.slice(F.transform(pair["c"], row), 1, most).cast(SOURCE)

    bare = F.array(F.struct(F.lit(bare_title).alias("title"), F.lit("").alias("url"), F.substring(told, 1, BARE_SNIPPET).alias("snippet"), F.lit(BARE_SCORE).alias("score"), told.alias("answer"))).cast(SOURCE)
    none = F.array().cast(SOURCE)
    return bound(F.struct(once.alias("c"), said.alias("s")), lambda p: F.when(F.size(p["c"]) > 0, with_snippets(p)).when(told != "", bare).otherwise(none))


def grounded(answers: DataFrame, most: int = 5) -> DataFrame:
    """(request_id, ord, title, url, snippet, score, answer) of answers."""
    found = sources_of(F.col("answer"), F.col("chunks"), F.col("supports"), most)
    return answers.select("request_id", F.posexplode(found).alias("ord", "s")).select("request_id", "ord", "s.*")


def researched(requests: DataFrame, ask: Callable[[DataFrame, int], DataFrame], most: int = 10, rounds: int = 2) -> DataFrame:
    """Sources of requests(request_id, ...), of up to `rounds` answers each: rows as of grounded().

    ask(requests, round) gives answers; from the second round on the requests have `context`, the last
    answer, and only those that have fewer than `most` sources are asked. A round adds what no
    earlier one had, by url."""
    asked, known, last = requests, None, None
    for k in range(rounds):
        answers = materialise(ask(asked, k).select("request_id", "answer", "chunks", "supports"), "answers")
        own = answers.select("request_id", F.posexplode(F.filter(sources_of(F.lit(""), F.col("chunks"), F.col("supports"), 1 << 20), lambda s: s["url"] != "")).alias("ord", "s")).select("request_id", F.lit(k).alias("round"), "ord", "s.*")
        new = own if known is None else own.join(known.select("request_id", "url"), ["request_id", "url"], "left_anti").select(own.columns)
        known = materialise(new if known is None else known.unionByName(new), "sources")
        last = answers.select("request_id", F.col("answer").alias("context"))
        full = known.groupBy("request_id").count().filter(F.col("count") >= most).select("request_id")
        asked = requests.join(full, "request_id", "left_anti").join(last, "request_id")
    order = Window.partitionBy("request_id").orderBy("round", "ord")
    return known.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).filter(F.col("ord") < most).drop("round", "answer")
