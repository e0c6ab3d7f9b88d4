"""Main text of web pages: page structure, and nearest-URL page differencing.

Structure comes first. Scripts, styles, comments in the markup, menus, headers, footers,
sidebars, forms, and whatever a class, id or role names as an advert, a notice, reader
comments and the like are left out. If the page marks its article (an `article` or
`main` element with text), only the blocks in it stay.

Page differencing then decides on every page's blocks, its lines. Pages of a host with the very
same lines are one body, so that equal pages always get equal texts, and a copy is never
asked about templates. The distinct bodies of a host, those of marked articles by themselves, are
ordered by URL path, and aligned by longest common subsequence with their neighbours. Lines that
pages share go:

- Of a page without a marked article, those that it shares with one neighbour: the one before or
  after that has the longer part of the path in common.
- Of a marked article, those that it shares with all of its neighbours, up to REACH before and REACH
  after, if there are two or more. Articles share licences, quotations and whole passages with one
  other page too, which belong to the text; one page alone can't tell these from a template.

Neither how long a page is nor how many pages a host has decides otherwise. Neighbours meet by
their number in a range-partitioned order, so a host of any size spreads over tasks, and only
line hashes travel. A body's result goes to all its pages; copies are spread over SPREAD keys.

Edge cases: a null html is empty and has the text ''; pages without a readable url are one
host; unclosed and cut-off markup is read as far as it goes; repeated rows are each
reported; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import common as C
from ..ordering import ranged, shifts

# HTML elements, and words in class, id and role that name what is no article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav footer aside form button menu dialog datalist fieldset audio video canvas map".split())
CONTAINERS = set("article main section div header ul ol dl table blockquote details figure center body html hgroup address".split())
OTHER_WORDS = set(
    "ad ads adbox advert adverts advertising advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "reply replies respond disqus discussion share sharing social related recommended recommendations widget toolbar pagination pager skip search hidden".split()
)
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
RAW = "script|style|template|noscript|svg|iframe|object|textarea|select|title|math"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{RAW})\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?=(?:{RAW})\s*>)[a-z]+\s*>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMED = re.compile(r"[a-z]+|[A-Z][a-z]*")
PARSED = "uid long, page_id long, url string, host string, path string, marked boolean, blocks array<string>"
REACH = 2
SPREAD = 16
RESULT = "page_id long, url string, text string, n_chars long"


def is_other(name: str, more: str, inside_article: bool) -> bool:
    """Whether an element's tag names it as something else than article text."""
    if name in DROPPED or (name == "header" and not inside_article):
        return True
    if not more or name in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(more):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key == "role" and value.lower() in OTHER_ROLES:
            return True
        if key in ("class", "id"):
            words = {w.lower() for w in NAMED.findall(value)}
            if words & OTHER_WORDS or (words & {"header"} and not inside_article):
                return True
    return False


def blocks_of(source: str) -> tuple[list[str], bool]:
    """A page's text blocks that may be its article, and whether the page marks them so."""
    marked: list[str] = []
    others: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, left out, article
    out = article = 0

    def flush() -> None:
        block = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if block:
            (marked if article else others).append(block)

    def close(k: int) -> None:
        nonlocal out, article
        flush()
        while len(stack) > k:
            _, dropped, own = stack.pop()
            out -= dropped
            article -= own

    at = 0
    for m in MARKUP.finditer(source):
        if not out and m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in INLINE and name not in VOID:
            if not m["end"]:
                if m["more"] and is_other(name, m["more"], article > 0):
                    stack.append((name, True, False))
                    out += 1
            elif stack and stack[-1][0] == name:
                _, dropped, own = stack.pop()
                out -= dropped
            continue
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is None:
                if not out:
                    flush()
            else:
                close(k)
            continue
        if name in VOID:
            if name in ("br", "hr") and not out:
                flush()
            continue
        if not out:
            flush()
        if stack and stack[-1][0] in ("p", "li", "dt", "dd") and (name == stack[-1][0] or (stack[-1][0] == "p" and name != "span")):
            close(len(stack) - 1)  # these end where the next block starts
        if m["more"].endswith("/"):
            continue
        dropped = is_other(name, m["more"], article > 0)
        own = name in ("article", "main") and not dropped
        if dropped or own or name in CONTAINERS or name in DROPPED:
            stack.append((name, dropped, own))
            out += dropped
            article += own
    if not out:
        held.append(source[at:])
        flush()
    return (marked, True) if marked else (others, False)


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


def longest_common(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b (by Hunt and Szymanski's tails)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    where: dict = {}
    for j in range(head, len(b) - tail):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def bodies(lines: DataFrame) -> DataFrame:
    """The distinct bodies of lines(host, marked, path, body, lines), with the smallest path, and the number `at` in order of host, kind and path."""
    each = lines.groupBy("host", "marked", "body").agg(F.min("path").alias("path"), F.min("lines").alias("lines"))
    rows = ranged(each, ["host", "marked", "path", "body"], "lines")
    return rows.join(shifts(rows, [], F.lit(1)), "_part").withColumn("at", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def depth(a: str, b: str) -> int:
    """How many leading parts two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def deletions(lines: DataFrame, reach: int = REACH) -> DataFrame:
    """Which lines of each body of lines(host, marked, path, body, lines) go: host, marked, body, gone (their places); bodies that lose none are left out."""
    own = bodies(lines)
    step = F.explode(F.array(*map(F.lit, range(-reach, reach + 1)))).alias("step")
    met = own.select("*", step).groupBy((F.col("at") - F.col("step")).alias("at")).agg(F.collect_list(F.struct("step", "host", "marked", "body", "path", "lines")).alias("near"))

    def align(batches):
        for batch in batches:
            rows = []
            for near in batch.column(0).to_pylist():
                by = {r["step"]: r for r in near}
                if 0 not in by:
                    continue
                own = by.pop(0)
                by = {k: r for k, r in by.items() if (r["host"], r["marked"]) == (own["host"], own["marked"])}
                if not own["marked"]:
                    nearest = max((k for k in (-1, 1) if k in by), key=lambda k: depth(own["path"], by[k]["path"]), default=None)
                    gone = longest_common(own["lines"], by[nearest]["lines"]) if nearest else set()
                else:
                    gone = set.intersection(*(longest_common(own["lines"], r["lines"]) for r in by.values())) if len(by) > 1 else set()
                if gone:
                    rows.append((own["host"], own["marked"], own["body"], sorted(gone)))
            types = (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["host", "marked", "body", "gone"])

    return met.select("near").mapInArrow(align, "host string, marked boolean, body string, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each row of pages(page_id, url, html): see RESULT."""
    C.ship(pages.sparkSession)

    def parse(batches):
        uid = TaskContext.get().partitionId() << 33
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        for batch in batches:
            rows = []
            for page_id, url, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                blocks, marked = blocks_of(source or "")
                rows.append((uid, page_id, url, *host_and_path(url), marked, blocks))
                uid += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["uid", "page_id", "url", "host", "path", "marked", "blocks"])

    parsed = materialise(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(parse, PARSED), "pages", compression="zstd")
    hashed = F.transform("blocks", lambda b: F.xxhash64(b))
    lines = parsed.filter(F.size("blocks") > 0).select("uid", "host", "path", "marked", hashed.alias("lines")).withColumn("body", F.md5(F.array_join(F.col("lines").cast("array<string>"), " ").cast("binary")))
    of_body = materialise(deletions(lines), "bodies").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    own = lines.select("uid", "host", "marked", "body", F.pmod(F.xxhash64("uid"), F.lit(SPREAD)).cast("int").alias("deal"))
    gone = materialise(own.join(of_body, ["host", "marked", "body", "deal"]).select("uid", "gone"), "gone")  # its size is known then, and texts need not be shuffled for a small one
    left = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b, k: ~F.array_contains("gone", k)))
    text = F.array_join(left, "\n")
    return parsed.join(gone, "uid", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
