"""Calls to search providers: who is called, when calls end, what comes back; and providers as a data source."""

import collections
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dispatch
from marlstone.sources import providers, sinks

REQUEST = "request_id long, query string, mode string, excluded array<string>"


def noted(folder, name, delay=0.0, fail=False, rows=5):
    """A provider that leaves a line for each call in a file of its name."""

    def load():
        with open(folder / f"{name}.loads", "a") as f:
            f.write("x")

        def search(query, most, mode):
            with open(folder / f"{name}.calls", "a") as f:
                f.write(f"{query}|{mode}\n")
            time.sleep(delay)
            if fail:
                raise RuntimeError("down")
            return [{"title": f"{name} {i}", "url": f"http://{name}/{i}", "snippet": "s" * 900, "score": i, "answer": "" if i < 2 else f"a{i}"} for i in range(rows)]

        return search

    return load


def lines(folder, name):
    path = folder / f"{name}.calls"
    return path.read_text().split("\n")[:-1] if path.exists() else []


def test_only_the_chosen_provider_is_called_once(spark, tmp_path):
    names = ["brave", "tavily", "gemini", "linkup", "newsdata", "exa"]
    made_up = {n: noted(tmp_path, n) for n in names}
    requests = spark.createDataFrame([(1, "q1", "quick", None), (2, "q2", "code", []), (3, "latest news today", None, None), (4, "q4", "quick", ["brave"]), (5, "q5", "deep", names), (6, None, "quick", None)], REQUEST)
    found, made = dispatch.live_search(requests, made_up, most=4)
    for _ in range(2):  # read twice, called once
        got = {r.request_id: r for r in found.collect()}
    assert {k: r.provider_used for k, r in got.items()} == {1: "brave", 2: "tavily", 3: "newsdata", 4: "tavily", 5: None, 6: "brave"}
    assert got[5].error == "no provider" and got[5].sources == [] and not got[5].can_escalate and got[3].mode == "news"
    assert got[1]["count"] == 4 and got[1].answer == "a2" and [s.title for s in got[1].sources] == [f"brave {i}" for i in range(4)] and len(got[1].sources[0].snippet) == 500
    assert {n: sorted(lines(tmp_path, n)) for n in names} == {"brave": ["q1|quick", "|quick"], "tavily": ["q2|code", "q4|quick"], "gemini": [], "linkup": [], "newsdata": ["latest news today|news"], "exa": []}
    assert dispatch.usage_of(made).groupBy("provider").count().count() == 3
    sinks.log_requests(dispatch.request_log(made), str(tmp_path / "log"))
    logged = spark.read.json(str(tmp_path / "log")).collect()
    assert len(logged) == 5 and all(r.hits == 4 and r.ms >= 0 and r.urls[0].startswith("http://") for r in logged)


def test_slow_failing_and_missing_providers(spark, tmp_path):
    def not_there():
        raise KeyError("no key")

    made_up = {"brave": noted(tmp_path, "brave", delay=60), "tavily": noted(tmp_path, "tavily", fail=True), "linkup": not_there, "exa": noted(tmp_path, "exa", rows=2)}
    rows = [(k, f"q{k}", m, None) for k, m in enumerate(["quick"] * 20 + ["code"] * 3 + ["company"] * 3)]
    began = time.monotonic()
    found, made = dispatch.live_search(spark.createDataFrame(rows, REQUEST), made_up, seconds={"": 1.0}, lanes=2, in_flight=8)
    got = collections.Counter((r.mode, r.provider_used, r.status, r["count"], r.error, r.can_escalate) for r in found.collect())
    assert time.monotonic() - began < 45  # twenty calls of a minute each, at eight a time in two tasks
    assert got == {("quick", "brave", "timeout", 0, None, True): 20, ("code", "tavily", "failed", 0, None, True): 3, ("company", "exa", "ok", 2, None, True): 3}
    assert all(1000 <= r.ms < 20000 for r in made.filter("status = 'timeout'").collect())
    again = dispatch.escalation(found, spark.createDataFrame(rows, REQUEST))
    assert {(tuple(r.excluded)) for r in again.filter("mode = 'company'").collect()} == {("exa",)}
    alone, _ = dispatch.live_search(spark.createDataFrame([(1, "x", "company", None)], REQUEST), {})
    assert alone.first().error == "no provider"
    assert dispatch.live_search(spark.createDataFrame([], REQUEST), made_up)[0].count() == 0


def test_many_calls_in_flight():
    """A hundred calls of 50 ms, twenty at a time, take far less than one after the other; late results are dropped."""
    began = time.monotonic()
    ended = list(dispatch.ask_all(lambda query, most, mode: time.sleep(0.05) or [{"title": query}], ((k, str(k), "") for k in range(100)), 3, lambda mode: 5.0, 20))
    assert time.monotonic() - began < 2 and sorted(n for n, *_ in ended) == list(range(100)) and all(s == "ok" and r[0]["title"] == str(n) for n, s, _, _, r in ended)
    slow = list(dispatch.ask_all(lambda query, most, mode: time.sleep(0.4 if query == "slow" else 0) or [{}], [(0, "slow", ""), (1, "x", ""), (2, "x", "")], 3, lambda mode: 0.1, 1))
    assert [(n, s) for n, s, *_ in slow] == [(0, "timeout"), (1, "ok"), (2, "ok")]


@pytest.mark.parametrize("found", [[{"title": "t", "score": None}], [], ({"url": str(k)} for k in range(50))])
def test_results_in_one_shape(found):
    rows = dispatch.as_results(found, "deep", 3)
    assert len(rows) <= 3 and all(set(r) == {"ord", "title", "url", "snippet", "score", "answer"} and r["snippet"] == "" for r in rows)


def test_filters_go_to_the_source(spark, tmp_path):
    def service(name):
        def search(query, k, mode=None, domains=None, since=None, depth=None):
            with open(tmp_path / "calls", "a") as f:
                f.write(f"{name}|{query}|{mode}|{','.join(domains or [])}|{since}|{depth}\n")
            return [{"title": name, "url": f"http://www.h{i % 3}.com/{i}", "published": datetime(2024, 1, 1 + i)} for i in range(k)]

        return search

    def calls():
        out = sorted((tmp_path / "calls").read_text().split("\n")[:-1])
        (tmp_path / "calls").unlink()
        return out

    providers.register(spark, "several", {n: service(n) for n in "abc"})
    every = spark.read.format("search-several").option("query", "q1\nq2").option("k", 6).load()
    some = every.filter("provider in ('a', 'b') and query = 'q1' and host = 'h1.com' and published > timestamp'2024-01-02 00:00:00' and mode = 'deep' and title <> 'b'")
    assert "PushedFilters: [In(provider, [a,b]), EqualTo(query,q1), EqualTo(mode,deep)]" in some._jdf.queryExecution().explainString(some._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [(r.title, r.url, r.depth) for r in some.collect()] == [("a", "http://www.h1.com/4", "deep")]  # host, date and title hold for what came back
    assert calls() == [f"{n}|q1|deep|h1.com|2024-01-02 00:00:00+00:00|deep" for n in "ab"]
    assert every.filter("provider = 'c' and depth = 'fast'").count() == 12 and calls() == ["c|q1|search||None|fast", "c|q2|search||None|fast"]
    assert every.filter("mode in ('news', 'deep') and provider = 'a' and query = 'q2'").groupBy("mode").count().orderBy("mode").collect() == [("deep", 6), ("news", 6)]
    first, second = calls()
    assert first == "a|q2|deep||None|deep" and second.startswith("a|q2|news||20") and second.endswith("|standard")  # news: the past week
    assert every.filter("provider = 'x'").count() == 0 and every.filter("provider = 'a' and provider = 'b'").count() == 0 and not (tmp_path / "calls").exists()
    bare = lambda: spark.read.format("search-several").option("k", 2).load()
    assert bare().filter(F.col("query").isin("x", "y") & (F.col("provider") == "a")).count() == 4 and bare().count() == 0
    assert providers.host_in("HTTP://u@WWW.A.com:80/x?y") == "a.com" and providers.host_in("nope") == "" and providers.host_in(None) is None
