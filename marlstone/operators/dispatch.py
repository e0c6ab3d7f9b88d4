"""Calls to search providers, made from tasks: many in flight, each with a deadline.

A provider is a name with a function `load`, called once in a task, which gives a search
function (query, k, mode) -> rows with title, url, snippet, score, answer (any may be missing).
Whatever goes wrong ends one call, never the job: a call that raises has failed, one that
outlives the deadline of its mode has timed out, and a provider whose load() raises is
unavailable. None of these has results.

Requests are dealt to tasks by provider and lane, so that a task talks to one provider over
one loaded client; a provider with most of the requests spreads over `lanes` tasks, and
lanes * in_flight is the most calls that it sees at a time. Outside services aren't asked
twice for what is read twice: calls are written once, and everything else reads that.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from datetime import datetime, timezone
from queue import Empty, SimpleQueue
from threading import Thread

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import routing

Search = Callable[..., Iterable[Mapping]]
Providers = Mapping[str, Callable[[], Search]]
SOURCE = "struct<ord:int,title:string,url:string,snippet:string,score:double,answer:string>"
CALL = f"request_id long, provider string, mode string, query string, status string, ts timestamp, ms double, results array<{SOURCE}>"
#: The longest snippet of each mode.
SNIPPETS = {"deep": 800, "code": 800, "extract": 800, "crawl": 800, "map": 0, "grounded": 200}
SNIPPET = 500
LANES, IN_FLIGHT, MOST = 8, 16, 10


def as_results(found: Iterable[Mapping], mode: str, most: int) -> list[dict]:
    """What a provider gave, in the shape of SOURCE."""
    out = []
    for n, r in enumerate(found):
        if n == most:
            break
        score = r.get("score")
        out.append({"ord": n, "title": r.get("title"), "url": r.get("url"), "snippet": (r.get("snippet") or "")[: SNIPPETS.get(mode, SNIPPET)], "score": None if score is None else float(score), "answer": r.get("answer")})
    return out


def ask_all(search: Search, asked: Iterable[tuple[int, str, str]], most: int, deadline: Callable[[str], float], in_flight: int) -> Iterator[tuple[int, str, float, float, list[dict]]]:
    """(number, status, start, seconds, results) for each asked (number, query, mode), as calls end.

    Each call has a thread. One that outlives its deadline is left behind: its slot is free,
    and what it still gives is dropped."""
    done: SimpleQueue = SimpleQueue()
    running: dict[int, tuple[float, float, float]] = {}

    def call(number: int, query: str, mode: str) -> None:
        try:
            done.put((number, "ok", as_results(search(query, most, mode), mode, most), time.monotonic()))
        except Exception:  # any failure of an outside service
            done.put((number, "failed", [], time.monotonic()))

    def ended() -> Iterator[tuple[int, str, float, float, list[dict]]]:
        try:
            number, status, results, at = done.get(timeout=max(0.0, min(end for _, _, end in running.values()) - time.monotonic()))
        except Empty:
            now = time.monotonic()
            for number in [n for n, (_, _, end) in running.items() if end <= now]:
                wall, began, _ = running.pop(number)
                yield number, "timeout", wall, now - began, []
            return
        if number in running:
            wall, began, _ = running.pop(number)
            yield number, status, wall, at - began, results

    for number, query, mode in asked:
        while len(running) >= in_flight:
            yield from ended()
        began = time.monotonic()
        running[number] = time.time(), began, began + deadline(mode)
        Thread(target=call, args=(number, query, mode), daemon=True).start()
    while running:
        yield from ended()


def calls(requests: DataFrame, providers: Providers, most: int = MOST, seconds: Mapping[str, float] | None = None, lanes: int = LANES, in_flight: int = IN_FLIGHT) -> DataFrame:
    """One row (see CALL) for each of requests(request_id, provider, mode, query), written once.

    seconds has the deadlines of modes, and under "" that of all others."""
    limits = {"": 15.0, **routing.TIMEOUTS} if seconds is None else dict(seconds)
    held = dict(providers)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Search | None] = {}
        for frame in frames:
            for name, own in frame.groupby("provider", dropna=False):
                if name not in loaded:
                    try:
                        loaded[name] = held[name]()
                    except Exception:  # not known, without a key, or down
                        loaded[name] = None
                own = own.reset_index(drop=True)
                if loaded[name] is None:
                    found = [(n, "unavailable", time.time(), 0.0, []) for n in range(len(own))]
                else:
                    asked = list(zip(range(len(own)), own["query"].fillna(""), own["mode"].fillna(""), strict=True))
                    found = list(ask_all(loaded[name], asked, most, lambda mode: limits.get(mode, limits.get("", 15.0)), in_flight))
                rows = [(own.at[n, "request_id"], name, own.at[n, "mode"], own.at[n, "query"], status, datetime.fromtimestamp(wall, timezone.utc), 1000 * took, results) for n, status, wall, took, results in found]
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CALL.split(", ")])

    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), "provider", "mode", "query").withColumn("_lane", F.pmod(F.xxhash64("request_id"), F.lit(lanes)))
    return materialise(rows.repartition("provider", "_lane").drop("_lane").mapInPandas(ask, CALL), "calls")


def chosen(requests: DataFrame, excluded) -> DataFrame:
    """requests(mode, [configured], [near]) with `provider`: the one to ask, null if all there are have been tried."""
    given = {c: F.col(c) for c in ("configured", "near") if c in requests.columns}
    pick = routing.choose_provider(F.col("mode"), excluded, **given)
    return requests.withColumn("provider", F.when(~F.array_contains(excluded, pick), pick))


def live_search(requests: DataFrame, providers: Providers, most: int = MOST, few: int = routing.ESCALATE_BELOW, **parameters) -> tuple[DataFrame, DataFrame]:
    """A response for each of requests(request_id, query, mode, [excluded], [configured], [near]), and the calls made.

    One provider is asked for each request: its mode's first that is configured, not excluded and
    not near its limit. Where that one turns out to be unavailable, one other is asked. A mode of
    'auto' or none is told from the query. With excluded, this is an escalation: providers tried
    before aren't asked again, and a request without any left has the error 'no provider'."""
    none = F.array().cast("array<string>")
    asked = requests.withColumn("excluded", F.coalesce(F.col("excluded"), none) if "excluded" in requests.columns else none)
    asked = asked.withColumn("mode", F.when(F.coalesce("mode", F.lit("auto")) == "auto", routing.classify(F.col("query"))).otherwise(F.col("mode")))
    asked = materialise(asked, "requests")  # modes are told once, not wherever they are used
    first = chosen(asked, F.col("excluded"))
    made = calls(first.filter("provider is not null"), providers, most, **parameters)
    lost = made.filter("status = 'unavailable'").select("request_id", F.array("provider").alias("lost"))
    second = chosen(asked.join(lost, "request_id").withColumn("_out", F.array_union("excluded", "lost")), F.col("_out")).filter("provider is not null")
    again = calls(second, providers, most, **parameters)
    made = made.filter("status <> 'unavailable'").unionByName(again)
    given = {c: F.col(c) for c in ("configured", "near") if c in requests.columns}
    real = made.filter("status <> 'unavailable'")
    answer = F.get(F.filter(F.transform("results", lambda r: r["answer"]), lambda a: F.coalesce(a != "", F.lit(False))), F.lit(0))
    sources = F.transform("results", lambda r: F.struct(r["ord"].alias("ord"), r["title"].alias("title"), r["url"].alias("url"), r["snippet"].alias("snippet"), F.col("provider").alias("provider"), r["score"].alias("score")))
    held = real.select("request_id", "provider", "status", "ms", answer.alias("answer"), sources.alias("sources"))
    n = F.size("sources")
    thin = F.col("provider").isNotNull() & (n < few)
    following = routing.choose_provider(F.col("mode"), F.array_union("excluded", F.array("provider")), **given)
    out = asked.join(held, "request_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(held.schema["sources"].dataType)))
    return out.select(
        "request_id", "mode", F.col("provider").alias("provider_used"), "status", n.cast("long").alias("count"), "answer", "sources", thin.alias("can_escalate"), F.when(thin, following).alias("escalate_to"),
        F.when(F.col("provider").isNull(), "no provider").alias("error"), F.col("excluded").alias("previously_tried"), "ms",
    ), made


def escalation(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests to ask again: those whose response was thin, with its provider excluded."""
    thin = responses.filter("can_escalate").select("request_id", F.array_union("previously_tried", F.array("provider_used")).alias("excluded"))
    return requests.drop("excluded").join(thin, "request_id")


def usage_of(made: DataFrame) -> DataFrame:
    """What calls add to a usage log: one row for each call that reached its provider, however it ended."""
    return made.filter("status <> 'unavailable'").select("provider", "ts")


def request_log(made: DataFrame) -> DataFrame:
    """Calls as rows of the request log, with the hits and milliseconds that were measured."""
    return made.select("ts", "query", F.to_json(F.struct("mode", "provider", "status")).alias("filters"), F.size("results").alias("hits"), "ms", F.transform("results", lambda r: r["url"]).alias("urls"))


def first_of_window(requests: DataFrame, keys: list[str], hits) -> DataFrame:
    """requests with `asked`: the request whose call serves it, the latest one of its key that the cache didn't answer."""
    order = Window.partitionBy(*keys).orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("asked", F.last(F.when(~hits, F.col("request_id")), ignorenulls=True).over(order))
