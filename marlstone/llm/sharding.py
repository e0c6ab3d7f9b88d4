"""Sharding by proportional stratified interleaving.

Within each source the rows are ranked in a seeded shuffle; row r of n gets the
fractional rank (r + 1/2) / n. In the order of fractional ranks the sources interleave in
proportion, so that cutting that order into equal runs gives shards which all have the
mixture of the whole, and whose row counts differ by one at most (the law `rows`).

Both orders are range-partitioned sorts over slim rows (the text is left behind with its
size and checksum), so a source of any share of the rows spreads over many tasks.

Edge cases: a null source is a source of its own; a null text has no bytes; repeated
rows are each placed; ties in the shuffle break by doc_id and checksum, and rows that are
equal in all of these are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordering import ranged, shifts

SHARDS = 8
SEED = 20240


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Each row of docs(doc_id, text, source): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    slim = slim.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    drawn = ranged(slim, ["_source", "_draw", "doc_id", "text_crc32"], "drawn")
    # numbers within a source: the partition's row number, less where the source starts in it
    starts = drawn.groupBy("_source", "_part").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_held"))
    total = starts.groupBy("_source").agg(F.sum("_held").alias("_n"))
    shift = shifts(drawn, ["_source"], F.lit(1))
    key = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n"))  # nulls join too
    facts = (
        starts.withColumn("_key", key).drop("_source")
        .join(shift.withColumn("_key", key).drop("_source"), ["_key", "_part"])
        .join(total.withColumn("_key", key).drop("_source"), "_key")
    )
    ranked = drawn.withColumn("_key", key).join(facts, ["_key", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - F.col("_from"))
    fraction = ((F.col("_rank") * 2 + 1) / (F.col("_n") * 2)).alias("_fraction")
    mixed = ranged(ranked.select("doc_id", "size", "text_crc32", fraction, "_draw"), ["_fraction", "_draw", "doc_id", "text_crc32"], "mixed")
    offset = shifts(mixed, [], F.lit(1))
    n = mixed.count()
    small, larger = divmod(n, shards)
    place = mixed.join(offset, "_part").withColumn("_at", F.col("_before") + F.col("_row"))
    head = larger * (small + 1)  # the first `larger` shards have one row more
    first = F.col("_at") < head
    shard = F.when(first, F.floor(F.col("_at") / (small + 1))).otherwise(larger + F.floor((F.col("_at") - head) / max(small, 1)))
    slot = F.when(first, F.col("_at") % (small + 1)).otherwise((F.col("_at") - head) % max(small, 1))
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
