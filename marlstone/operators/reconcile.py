"""Matching of catalogue items with live listings, one to one, and their discrepancies."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..session import materialise

TITLE_RATIO, PRICE_SHARE = 0.72, 0.10
UNAVAILABLE = ["out of stock", "unavailable", "false", "no"]


def brand_in(brand: Column, *texts: Column) -> Column:
    """Whether the normalised brand is part of any text; a blank brand is in none."""
    own = one_line(brand)
    found = F.lit(False)
    for t in texts:
        found |= F.contains(one_line(t), own)
    return (own != "") & found


def matched_characters(a: str, b: str) -> int:
    """Characters in matching blocks: the longest block that both have (the first in a, then in b), and so on
    in what is left before it and behind it."""
    total, spans = 0, [(0, len(a), 0, len(b))]
    while spans:
        a_lo, a_hi, b_lo, b_hi = spans.pop()
        size = a_at = b_at = 0
        ending = [0] * (b_hi - b_lo + 1)  # lengths of the blocks that end at each place of b and the current place of a
        for i in range(a_lo, a_hi):
            last = ending
            ending = [0] * len(last)
            for k, c in enumerate(b[b_lo:b_hi]):
                if c == a[i]:
                    ending[k + 1] = n = last[k] + 1
                    if n > size:
                        size, a_at, b_at = n, i - n + 1, b_lo + k - n + 1
        if size:
            total += size
            spans += [(a_lo, a_at, b_lo, b_at), (a_at + size, a_hi, b_at + size, b_hi)]
    return total


def title_scores(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) of distinct titles with their similarity `score`, those that reach least: twice the characters
    in matching blocks over both lengths. Pairs whose lengths alone rule that out aren't compared."""
    n = F.length("a") + F.length("b")

    @F.pandas_udf("long")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([matched_characters(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    near = pairs.filter((F.col("a") != "") & (F.col("b") != "") & (2.0 * F.least(F.length("a"), F.length("b")) / n >= least))
    return near.withColumn("score", 2.0 * matched("a", "b") / n).filter(F.col("score") >= least)


def scored_pairs(private: DataFrame, live: DataFrame, by: list[str], titles: bool = True) -> DataFrame:
    """Pairs within a group with tier (3 sku, 2 brand, 1 title) and score.

    private(*by, item, sku, title, brand), live(*by, listing, sku, title, snippet). Groups
    are a query's few results, so pairs stay few; the join is by the group's key."""
    p = private.select(*by, "item", F.col("sku").alias("p_sku"), F.col("title").alias("p_title"), "brand")
    q = live.select(*by, "listing", F.col("sku").alias("l_sku"), F.col("title").alias("l_title"), "snippet")
    tier = F.when((F.col("p_sku") == F.col("l_sku")) & (F.col("p_sku") != ""), 3).when(brand_in(F.col("brand"), F.col("l_title"), F.col("snippet")), 2)
    pairs = p.join(q, by).withColumn("tier", tier.cast("long")).withColumn("score", F.when(F.col("tier").isNotNull(), F.lit(1.0)))
    known = pairs.filter("tier is not null")
    if titles:
        rest = pairs.filter("tier is null").drop("score").withColumns({"a": one_line(F.col("p_title")), "b": one_line(F.col("l_title"))})
        scores = title_scores(rest.select("a", "b").distinct(), TITLE_RATIO)  # each two titles once, however many rows have them
        known = known.unionByName(rest.join(scores, ["a", "b"]).withColumn("tier", F.lit(1).cast("long")), allowMissingColumns=True)
    return known.select(*by, "item", "listing", "tier", "score")


def assign(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Greedy one-to-one assignment within each group, best pair first (ties by item, then listing).

    In rounds: a pair that is the best one of its item and of its listing is what greedy would
    take; it is kept, and the other pairs of both go. Groups of any size spread over tasks, by
    item and by listing; all groups take their rounds together, until no pair is left."""
    order = F.struct((-F.col("tier")).alias("tier"), (-F.col("score")).alias("score"), "item", "listing")
    of_item, of_listing = Window.partitionBy(*by, "item"), Window.partitionBy(*by, "listing")
    left, kept = pairs.dropDuplicates([*by, "item", "listing", "tier", "score"]), []
    while True:
        rows = left.withColumn("_o", order).withColumn("_best", (F.min("_o").over(of_item) == F.col("_o")) & (F.min("_o").over(of_listing) == F.col("_o")))
        rows = rows.withColumn("_gone", F.max("_best").over(of_listing)).withColumn("_gone", F.col("_gone") | F.max("_best").over(of_item))
        now = materialise(rows.drop("_o"), "assigned")
        kept.append(now.filter("_best").select(*pairs.columns))
        left = now.filter("not _gone").select(*pairs.columns)
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, kept)


def discrepancy(private_price: Column, live_price: Column, availability: Column, share: float = PRICE_SHARE) -> tuple[Column, Column]:
    """Kind and detail of a discrepancy, price before availability."""
    gap = F.abs(live_price - private_price) / private_price
    price = (private_price > 0) & live_price.isNotNull() & (gap > share)
    away = F.lower(F.trim(availability)).isin(*UNAVAILABLE)
    kind = F.when(price, "price").when(away, "availability")
    return kind, F.when(price, F.format_string("price differs by %.0f%%", gap * 100)).when(away, F.concat(F.lit("listed as "), F.lower(F.trim(availability))))


def reconcile(private: DataFrame, live: DataFrame, by: list[str], share: float = PRICE_SHARE, titles: bool = True) -> DataFrame:
    """Each private row with its one live match, if any: adds listing, live_match(url, price, availability) and
    discrepancy(type, detail). The private row's own facts stay as they are.

    private(*by, item, sku, title, brand, price, ...), live(*by, listing, sku, title, snippet, url, price, availability)."""
    one = assign(scored_pairs(private, live, by, titles), by).select(*by, "item", "listing")
    facts = live.select(*by, "listing", F.struct("url", F.col("price").cast("double").alias("price"), F.col("availability").cast("string").alias("availability")).alias("live_match"))
    rows = private.join(one, [*by, "item"], "left").join(facts, [*by, "listing"], "left")
    kind, detail = discrepancy(F.col("price"), F.col("live_match.price"), F.col("live_match.availability"), share)
    return rows.withColumn("discrepancy", F.when(kind.isNotNull(), F.struct(kind.alias("type"), detail.alias("detail"))))


def unmatched(live: DataFrame, assigned: DataFrame, by: list[str]) -> DataFrame:
    return live.join(assigned.select(*by, "listing").distinct(), [*by, "listing"], "left_anti")
