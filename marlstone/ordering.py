"""Global row numbers and running sums without sending all rows through one task.

Rows are range-partitioned by their sort key (which also splits a hot key, as long as
the key's last column tells its rows apart), numbered within partitions, written once,
and shifted by what the partitions before hold: one row per partition (and group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import materialise

ROW_BITS = 33


def ranged(df: DataFrame, keys: list, name: str, parts: int | None = None) -> DataFrame:
    """df in the order of keys over partitions, with _part and _row (within the partition)."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1))
    return materialise(numbered, name)


def shifts(df: DataFrame, by: list[str], amount) -> DataFrame:
    """For each group and partition: `_before`, the sum of amount over the group's earlier partitions."""
    held = df.groupBy(*by, "_part").agg(F.sum(amount).alias("_held"))
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("_before", F.coalesce(F.sum("_held").over(window), F.lit(0))).drop("_held")


def earlier(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with `before`: how many rows of its group come earlier. A group of any size spreads over partitions."""
    rows = ranged(df, [*by, *order], name)
    starts = rows.groupBy(*by, "_part").agg(F.min("_row").alias("_from"))
    return rows.join(shifts(rows, by, F.lit(1)).join(starts, [*by, "_part"]), [*by, "_part"]).withColumn("before", (F.col("_before") + F.col("_row") - F.col("_from")).cast("long")).drop("_part", "_row", "_before", "_from")
