"""Whole turns, set at a time: guard, route, plan, retrieve, reconcile, answer, criticise, and answer again.

A turn is a row of turns(qid, text). Each step is a DataFrame stage over all turns; a
second answer is made for those turns only whose first one is to be revised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPEECH_SECONDS, speech_seconds, truncate_to_budget
from ..session import materialise
from . import answer, reconcile, routing, safety, search

ITEM = "struct<place:int,doc_id:string,title:string,price:double,rating:double,price_per_oz:double,ingredients:string,url:string,live_match:struct<url:string,price:double,availability:string>,discrepancy:struct<type:string,detail:string>>"
CITATIONS = "array<struct<doc_id:string,title:string,url:string,source:string>>"
BLOCKED = {
    True: "This request tries to change how the assistant works, which it can't follow. A plain product question is welcome.",
    False: "These products must not be mixed: together they give off toxic or corrosive gas. Use one at a time, rinse, and air the room.",
}
REVISE_BOUND = 1


def guarded(turns: DataFrame, hazards: dict = safety.HAZARDS, injections: dict = safety.INJECTIONS) -> DataFrame:
    """turns with safety_flags, injections first."""
    return turns.withColumn("safety_flags", F.concat(safety.injection_flags(F.col("text"), injections), safety.hazard_flags([F.col("text")], hazards)))


def retrieve(planned: DataFrame, index: dict[str, DataFrame], live: DataFrame, hosts: list[str] = safety.ALLOWED_HOSTS, **parameters) -> tuple[DataFrame, DataFrame]:
    """Private items (with one relaxed retry) and live results of planned turns(qid, query, sources, k, filters, call_web_search).

    live(qid, ord, title, url, snippet, price, availability) is what a live search has for a turn; a search
    that failed has nothing. Results off the allowed hosts stay, marked as blocked."""
    asked = planned.filter(F.contains("sources", F.lit("private"))).select("qid", F.col("query").alias("text"), "filters", "k")
    found = materialise(search.relaxed(asked, index, **parameters), "results")
    private = search.results(found.select("qid", "rank", "doc_id", "score"), index).join(found.select("qid", "rank", "relaxed"), ["qid", "rank"])
    private = materialise(private, "private")
    wanted = live.join(planned.filter("call_web_search").select("qid", "k"), "qid")
    taken = wanted.withColumn("_n", F.row_number().over(answer.by_turn("ord"))).filter(F.col("_n") <= F.col("k")).drop("_n", "k")
    return private, materialise(safety.with_block_reason(taken, hosts), "live")


def reconciled(private: DataFrame, live: DataFrame, share: float = reconcile.PRICE_SHARE, titles: bool = True) -> tuple[DataFrame, DataFrame]:
    """Items (qid, item) and the live rows that match none of them: private results with their live match and
    discrepancy, in rank order; for turns without any, the live rows themselves."""
    allowed = live.filter("allowed").withColumnRenamed("ord", "listing")
    own = private.withColumnRenamed("rank", "item")
    joined = materialise(reconcile.reconcile(own, allowed.withColumn("sku", F.lit("")), ["qid"], share, titles), "reconciled")
    fields = lambda price, place: [place.cast("int").alias("place"), "doc_id", "title", price.alias("price"), "rating", "price_per_oz", "ingredients", "url", "live_match", "discrepancy"]
    items = joined.select("qid", F.struct(*fields(F.col("price"), F.col("item"))).cast(ITEM).alias("item"))
    bare = allowed.join(private.select("qid").distinct(), "qid", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    match = F.struct("url", F.col("price").cast("double").alias("price"), F.col("availability").cast("string").alias("availability"))
    promoted = bare.select("qid", F.struct(F.col("listing").cast("int").alias("place"), none("string").alias("doc_id"), "title", F.col("price").cast("double").alias("price"), none("double").alias("rating"), none("double").alias("price_per_oz"), none("string").alias("ingredients"), "url", match.alias("live_match"), none("struct<type:string,detail:string>").alias("discrepancy")).cast(ITEM).alias("item"))
    matched = joined.filter("listing is not null").select("qid", "listing").unionByName(bare.select("qid", "listing"))
    left = allowed.join(matched, ["qid", "listing"], "left_anti")
    return items.unionByName(promoted), left


def offline_answer(rows: DataFrame, attempt: int) -> DataFrame:
    """The rule-based answer to rows(qid, items): speech, citations and the ids of the comparison table's rows."""
    top = F.get("items", F.lit(0))
    speech = answer.spoken_answer(top["title"], top["price"], top["rating"], F.greatest(F.size("items") - 1, F.lit(0)))
    cited = F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["title"].alias("title"), x["url"].alias("url"), F.when(x["doc_id"].isNotNull(), "private").otherwise("live").alias("source")))
    return rows.withColumns({"speech": F.when(F.size("items") == 0, answer.NOTHING).otherwise(speech), "citations": cited.cast(CITATIONS), "table_ids": F.transform("items", lambda x: x["doc_id"])})


def criticised(rows: DataFrame, revisions: int, hazards: dict = safety.HAZARDS) -> DataFrame:
    """Answered rows with grounded, unsafe, reasons, action and the final speech.

    Floors under any answerer: cited ids that retrieval doesn't have call for a revision;
    hazards named by question, answer and ingredients together put a caution in front,
    and leave the action."""
    cited = F.array_union(F.transform("citations", lambda c: c["doc_id"]), F.col("table_ids"))
    unknown = F.array_sort(F.array_compact(F.array_except(cited, F.transform("items", lambda x: x["doc_id"]))))
    flags = safety.hazard_flags([F.col("text"), F.col("speech"), F.array_join(F.transform("items", lambda x: F.coalesce(x["ingredients"], F.lit(""))), " ")], hazards)
    rows = rows.withColumns({"_unknown": unknown, "_flags": flags})
    warned = answer.cautioned(F.col("speech"), F.col("_flags"))
    reasons = F.array_compact(F.array(
        F.when(F.size("_unknown") > 0, F.concat(F.lit("cited but not retrieved: "), F.array_join(F.col("_unknown").cast("array<string>"), ","))),
        F.when(F.size("_flags") > 0, F.concat(F.lit("hazard: "), F.array_join("_flags", ","))),
    ))
    return rows.withColumns({
        "grounded": F.size("_unknown") == 0, "unsafe": F.size("_flags") > 0, "reasons": reasons, "action": F.when(F.size("_unknown") > 0, "revise").otherwise("accept"),
        "speech": F.when(speech_seconds(warned) > SPEECH_SECONDS, truncate_to_budget(warned)).otherwise(warned), "revisions": F.lit(revisions),
    }).drop("_unknown", "_flags")


def refused(turns: DataFrame) -> DataFrame:
    """The answers to blocked turns."""
    injected = F.exists("safety_flags", lambda f: F.startswith(f, F.lit("prompt_injection:")))
    none = F.array()
    return turns.withColumns({
        "items": none.cast(f"array<{ITEM}>"), "speech": F.when(injected, BLOCKED[True]).otherwise(BLOCKED[False]), "citations": none.cast(CITATIONS), "table_ids": none.cast("array<string>"), "grounded": F.lit(True),
        "unsafe": F.lit(True), "reasons": F.array(F.concat(F.lit("blocked: "), F.array_join("safety_flags", ","))), "action": F.lit("reject"), "revisions": F.lit(0),
    })


def answered(planned: DataFrame, items: DataFrame, answerer: Callable[[DataFrame, int], DataFrame] = offline_answer, hazards: dict = safety.HAZARDS, bound: int = REVISE_BOUND) -> DataFrame:
    """Each planned turn's final answer. A turn whose answer is to be revised gets up to `bound` more attempts;
    one that still fails keeps the action `revise`."""
    held = items.groupBy("qid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    open_turns = planned.filter("task <> 'blocked'").join(held, "qid", "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{ITEM}>")))
    columns = [*planned.columns, "items", "speech", "citations", "table_ids", "grounded", "unsafe", "reasons", "action", "revisions"]
    done = refused(planned.filter("task = 'blocked'")).select(*columns)
    latest = materialise(criticised(answerer(open_turns, 0), 0, hazards).select(*columns), "answered")
    for attempt in range(1, bound + 1):
        done = done.unionByName(latest.filter("action <> 'revise'"))
        again = latest.filter("action = 'revise'").select(*open_turns.columns)
        latest = materialise(criticised(answerer(again, attempt), attempt, hazards).select(*columns), "answered")
    return done.unionByName(latest)


def run(turns: DataFrame, index: dict[str, DataFrame], live: DataFrame, route: Callable[[DataFrame], DataFrame] = routing.route, answerer: Callable[[DataFrame, int], DataFrame] = offline_answer, hosts: list[str] = safety.ALLOWED_HOSTS, hazards: dict = safety.HAZARDS, injections: dict = safety.INJECTIONS, bound: int = REVISE_BOUND, **parameters) -> DataFrame:
    """One row for each of turns(qid, text): what was planned, found and said, the verdict, and the steps taken.

    Only accepted answers are spoken (`speak`)."""
    planned = materialise(routing.plan(route(guarded(turns, hazards, injections))), "planned")
    private, found = retrieve(planned, index, live, hosts, **parameters)
    items, left = reconciled(private, found)
    final = answered(planned, items, answerer, hazards, bound)
    n = lambda rows, name: rows.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    counts = final.join(n(private, "n_private"), "qid", "left").join(private.groupBy("qid").agg(F.bool_or("relaxed").alias("relaxed")), "qid", "left").join(n(found.filter("allowed"), "n_live"), "qid", "left").join(n(found.filter("not allowed"), "n_blocked"), "qid", "left").join(n(left, "n_unmatched"), "qid", "left")
    rows = counts.fillna(0, ["n_private", "n_live", "n_blocked", "n_unmatched"]).fillna(False, ["relaxed"])
    return rows.withColumns({"speak": F.col("action") == "accept", "steps": steps()})


def steps() -> Column:
    """The nodes that a turn went through, the retriever's three parts by themselves, a second answer included."""
    part = lambda on, name: F.when(on, F.lit(name))
    open_turn = F.col("task") != "blocked"
    return F.array_compact(F.array(
        F.lit("router"), F.lit("planner"), part(open_turn & F.contains("sources", F.lit("private")), "private_search"), part(open_turn & F.col("call_web_search"), "live_search"), part(open_turn, "reconcile"),
        F.lit("answer"), part(F.col("revisions") > 0, "answer_again"), part(F.col("action") == "accept", "speak"),
    ))


def markdown(traces: DataFrame) -> DataFrame:
    """Each trace as Markdown: traces(trace_id, step, node, elapsed_ms, [note])."""
    note = F.col("note") if "note" in traces.columns else F.lit(None).cast("string")
    line = F.concat(F.lit("## "), F.col("step").cast("string"), F.lit(". "), F.initcap(F.replace("node", F.lit("_"), F.lit(" "))), F.lit(" ("), F.col("elapsed_ms").cast("string"), F.lit(" ms)"), F.coalesce(F.concat(F.lit("\n_"), note, F.lit("_")), F.lit("")))
    held = traces.select("trace_id", F.struct("step", line.alias("line")).alias("s")).groupBy("trace_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return held.select("trace_id", F.concat(F.lit("# Steps\n\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n\n")).alias("markdown"))
