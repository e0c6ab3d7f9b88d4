"""Cache, throttle and other state, folded over ordered rows in batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import ranged


def cached(requests: DataFrame, keys: list[str], seconds: float, order: str = "ts") -> DataFrame:
    """requests(*keys, ts, ...) with `hit`: whether a cache answers, whose window only a miss opens.

    A key's arrivals pass through one Python generator in their order, batch by batch, so a
    hot key's history is never held as a whole; keys are spread over tasks."""
    width, schema = int(seconds * 1e6), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", hit boolean"
    rows = requests.withColumn("_at", F.unix_micros("ts")).repartition(*keys).sortWithinPartitions(*keys, "_at", order)
    n = len(requests.columns)

    def fold(batches):
        key, opened = None, 0
        for batch in batches:
            own = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            hits = []
            for k, at in zip(own, batch.column(n).to_pylist(), strict=True):
                hit = k == key and at < opened + width
                if not hit:
                    key, opened = k, at
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(hits, pa.bool_())], names=[*batch.schema.names[:n], "hit"])

    return rows.mapInArrow(fold, schema)


def cache_hits(requests: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Hits and misses of each key of requests(*keys, ts)."""
    return cached(requests.select(*keys, "ts"), keys, seconds).groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def throttle(calls: DataFrame, gap_micros: int, keys: list[str]) -> DataFrame:
    """When each of a serial caller's calls starts, gap_micros apart at least: calls(*keys, call_id, at), adds `start`.

    start(i) = max(at(i), start(i-1) + gap) = i * gap + max over j <= i of (at(j) - j * gap). No keys: all
    calls have one caller. Numbers and maxima are taken within the parts of a range-partitioned order, and
    carried on from part to part by one row for each caller and part; so a caller of any size spreads."""
    rows = ranged(calls.withColumn("_key", F.struct(*keys) if keys else F.lit(0)), ["_key", "at", "call_id"], "throttle")
    slack = F.col("at") - F.col("_row") * gap_micros  # by the part's own row numbers
    parts = rows.groupBy("_key", "_part").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n"), F.max(slack).alias("_peak"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from"))  # from those to numbers among the caller's calls
    parts = parts.withColumn("_most", F.max(F.col("_peak") - F.col("_shift") * gap_micros).over(before)).select("_key", "_part", "_shift", "_most")
    so_far = Window.partitionBy("_key", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.max(slack).over(so_far) - F.col("_shift") * gap_micros
    return rows.join(parts, ["_key", "_part"]).withColumn("start", (F.col("_shift") + F.col("_row")) * gap_micros + F.greatest(own, F.col("_most"))).select(*calls.columns, "start")


def last_of(rows: DataFrame, key: str, order: list[str], n: int = 8) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
