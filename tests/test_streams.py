"""Streams over several files in disorder give what batch gives, and their state ends."""

import collections
import glob
import random

from pyspark.sql import functions as F

from marlstone.operators import state as batch
from marlstone.streaming import state as S

CALL = "user_id long, event_id long, ts timestamp"


def calls(spark, n=300, seed=1):
    """Five users over a day, with ties; one of them is busy."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), k, 1_700_000_000 + rng.randrange(86_400) // 20 * 20) for k in range(n)]
    return spark.createDataFrame(rows, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))


def stream(spark, rows, folder, **parameters):
    S.deal_in_files(rows, folder, **parameters)
    return S.files_stream(spark, folder, rows.schema).withColumnRenamed("event_id", "id")


def test_disorder_within_the_delay(spark, tmp_path):
    rows = calls(spark)
    got = S.cached_requests(stream(spark, rows, f"{tmp_path}/a", files=6), ["user_id"], 300)
    want = batch.cached(rows, ["user_id"], 300, "event_id").select("user_id", "event_id", "hit")
    assert sorted(map(tuple, got.select("user_id", "id", "hit").collect())) == sorted(map(tuple, want.collect()))
    got = S.throttled(stream(spark, rows, f"{tmp_path}/b", files=3), ["user_id"], 90_000_000)
    want = batch.throttle(rows.withColumn("at", F.unix_micros("ts")).withColumnRenamed("event_id", "call_id"), 90_000_000, ["user_id"])
    assert sorted(map(tuple, got.select("id", "start").collect())) == sorted(map(tuple, want.select("call_id", "start").collect()))


def test_later_rows_are_dropped_and_idle_keys_go(spark, tmp_path):
    folder = f"{tmp_path}/c"
    at = lambda s: 1_700_000_000 + s
    files = [[(1, 1, at(0)), (2, 2, at(10))], [(1, 3, at(50)), (3, 4, at(2000))], [(2, 6, at(2100))], [(1, 5, at(60))], [(None, None, at(90_000))]]
    for rows in files:  # row 5 comes once rows of its time have been taken
        spark.createDataFrame(rows, "user_id long, id long, s long").select("user_id", "id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    seen = []
    rows = S.folded(S.files_stream(spark, folder, spark.read.parquet(folder).schema), ["user_id"], S.cache_step(120), "hit", "10 minutes")
    query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
    query.awaitTermination()
    assert sorted(seen) == [(1, 1, 0), (1, 3, 1), (2, 2, 0), (2, 6, 0), (3, 4, 0)]
    held = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(h["numValueStateVars"] for h in held) > 0
    left = spark.read.format("statestore").option("stateVarName", "held").load(f"{folder}-state")
    assert left.count() == 0
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{folder}-state")
    assert waiting.count() == 0


def test_many_keys_share_state_and_batches_have_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 8)
    rng, folder, keys = random.Random(3), f"{tmp_path}/e", ["user_id", "name", "day", "raw"]
    rows = [(rng.randrange(700), rng.choice(["a", None]), (1 << 60) + k, 1_700_000_000 + rng.randrange(20_000)) for k in range(3000)]
    rows = spark.createDataFrame(rows, "user_id long, name string, event_id long, s long").select("user_id", "name", F.timestamp_micros(F.lit(1_699_999_999_123_456)).alias("day"), F.unhex(F.lit("FF00")).alias("raw"), "event_id", F.timestamp_seconds("s").alias("ts"))
    S.deal_in_files(rows, folder, files=2, parts=3)
    assert len(glob.glob(f"{folder}/*.parquet")) == 2 * 3 + 1
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    stream = S.folded(S.files_stream(spark, folder, rows.schema, 3).withColumnRenamed("event_id", "id"), keys, S.cache_step(600), "hit")
    seen = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
    query.awaitTermination()
    asked = [p for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["numInputRows"] > 1 for p in asked) == 2
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in asked) < 100  # of some 1,400 keys
    want = batch.cached(rows, keys, 600, "event_id").select(*keys, "event_id", F.col("hit").cast("long"))
    order = lambda found: sorted(map(tuple, found), key=lambda r: r[-2])
    assert order(seen) == order(want.collect())


def test_steps():
    step, state, got = S.cache_step(1), None, []
    for at in (0, 999_999, 1_000_000, 1_500_000, 2_500_000):
        state, hit, until = step(state, at)
        got.append((hit, until))
    assert got == [(0, 1_000_000), (1, 1_000_000), (0, 2_000_000), (1, 2_000_000), (0, 3_500_000)]
    step, state, got = S.throttle_step(10), None, []
    for at in (0, 3, 50):
        state, start, _ = step(state, at)
        got.append(start)
    assert got == [0, 10, 50]


def test_usage_of_a_stream(spark, tmp_path):
    rows = calls(spark).withColumn("provider", F.concat(F.lit("p"), F.col("user_id").cast("string")))
    got = S.monthly_usage(stream(spark, rows, f"{tmp_path}/d"))
    want = collections.Counter(r.provider for r in rows.collect())
    assert {r.provider: r.calls for r in got.groupBy("provider").agg(F.sum("calls").alias("calls")).collect()} == want
