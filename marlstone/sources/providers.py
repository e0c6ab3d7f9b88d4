"""Search providers as a Spark data source: a slot that takes Python search functions.

    register(spark, "mine", {"mine": lambda query, k: [{"title": ..., "url": ..., "snippet": ..., "score": ...}]})
    spark.read.format("search-mine").option("query", "...").load().filter("provider = 'mine' and host = 'a.com'")

A partition is one query (a line of the option query) at one provider. Options: query, k, mode
(search, code, news, deep, extract, crawl, map, grounded: passed on, and setting how long snippets
are), depth, domains (comma-separated), dedup (true: of results with one url the first). For
extract, a line is a url.

Filters are pushed to the providers. Those on provider, query, mode and depth decide what is
called at all, and are done with that. Those on host and published (a lower bound) go to the
search function as `domains` and `since`, which may use them or not, so that Spark applies them
to the results too; in mode news, `since` is a week ago where nothing else is asked. A
search function gets those of mode, depth, domains and since that it has parameters for.

Spark keeps what was pushed with what load() returns: call load() again for a read without filters.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator, Mapping
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from ..functions.text import host_of
from ..operators.dispatch import SNIPPET, SNIPPETS

SCHEMA = "title string, url string, snippet string, score double, provider string, query string, answer string, ord int, mode string, depth string, host string, published timestamp"
#: The most results of a mode, and how far back news go.
MOST = {"news": 10, "crawl": 100}
NEWS_DAYS = 7
PUSHED = ("provider", "query", "mode", "depth")  # filters that need no second look
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class SearchReader(DataSourceReader):
    def __init__(self, searches: bytes, names: list[str], options: dict):
        self.searches, self.names, self.options = searches, names, options
        self.pushed: dict[str, list] = {}
        self.since: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, (EqualTo, In)) and column in (*PUSHED, "host"):
                values = list(f.value) if isinstance(f, In) else [f.value]
                self.pushed[column] = [v for v in self.pushed.get(column, values) if v in values]
                if column in PUSHED:
                    continue
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == "published":
                self.since = max(self.since or f.value, f.value)
            yield f

    def values(self, column: str, default: list[str]) -> list[str]:
        """A column's values that are asked for: by the options or else by default, as far as filters let them through, or by filters alone."""
        given = self.options[column].split("\n") if self.options.get(column) else self.pushed.get(column, default)
        return [v for v in given if v in self.pushed.get(column, [v])]

    def partitions(self) -> list[InputPartition]:
        found = []
        for mode in self.values("mode", ["search"]):
            for depth in self.values("depth", ["deep" if mode == "deep" else "standard"]):
                found += [InputPartition((p, q, mode, depth)) for p in self.names if p in self.pushed.get("provider", [p]) for q in self.values("query", [])]
        return found or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A call's results, whatever keys they lack. A call that fails has none."""
        if partition.value is None:
            return
        name, query, mode, depth = partition.value
        search, k = cloudpickle.loads(self.searches)[name], int(self.options.get("k", "5"))
        hosts = self.options.get("domains", "").split(",") if self.options.get("domains") else self.pushed.get("host")
        since = self.since or (datetime.now(timezone.utc) - timedelta(days=NEWS_DAYS) if mode == "news" else None)
        hints = {"mode": mode, "depth": depth, "domains": hosts, "since": since}
        takes = inspect.signature(search).parameters
        every = any(p.kind is p.VAR_KEYWORD for p in takes.values())
        try:
            found = list(search(query, k, **{h: v for h, v in hints.items() if v is not None and (every or h in takes)}))
        except Exception:  # any failure of an outside service
            return
        seen: set = set()
        for n, r in enumerate(found[: min(k, MOST.get(mode, k))]):
            url = r.get("url")
            if url is not None and url in seen and self.options.get("dedup", "true") == "true":
                continue
            seen.add(url)
            yield r.get("title"), url, (r.get("snippet") or "")[: SNIPPETS.get(mode, SNIPPET)], r.get("score"), name, query, r.get("answer"), n, mode, depth, host_in(url), r.get("published")


def host_in(url: str | None) -> str | None:
    """As functions.text.host_of, for one url in a task."""
    rest = (url or "").partition("://")[2]
    for end in "/?#":
        rest = rest.partition(end)[0]
    host = rest.rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return host if url is not None else None


def register(spark: SparkSession, name: str, search: Callable[..., list[dict]] | Mapping[str, Callable[..., list[dict]]]) -> None:
    """Make one search function, or several by provider, available as spark.read.format("search-<name>").

    Turns on filter pushdown for Python data sources in the session."""
    searches = dict(search) if isinstance(search, Mapping) else {name: search}
    packed, names = cloudpickle.dumps(searches), list(searches)
    spark.conf.set(PUSHDOWN, "true")

    class Searches(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"search-{name}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return SearchReader(packed, names, dict(self.options))

    spark.dataSource.register(Searches)


def page_results(pages: DataFrame, extracted: Column, most: int = MOST["crawl"]) -> DataFrame:
    """Crawled pages(url, ...) in the shape of search results, the extracted text as snippet; at most `most` of a host, in order of url."""
    host = host_of(F.col("url"))
    n = F.row_number().over(Window.partitionBy("_host").orderBy("url"))
    rows = pages.withColumns({"_host": host, "snippet": F.substring(extracted, 1, SNIPPETS["crawl"])}).withColumn("_n", n).filter(F.col("_n") <= most)
    return rows.select(F.col("_host").alias("title"), "url", "snippet", F.lit(None).cast("double").alias("score"), F.lit("crawl").alias("provider"))


def plain_text(html: Column) -> Column:
    """A page's words: without scripts, styles and markup, white space as one blank."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
