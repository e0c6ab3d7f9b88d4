"""Streaming versions of the stateful operators. Sources are files, read to their end.

Rows may come out of order, and files too, by up to the watermark's delay: a key's rows wait in
its state until the watermark has passed them, and are taken in the order of event time then,
whichever batch brought them. Later ones than that are dropped. Timers of event time take the
waiting rows, and end a key's state once it says nothing any more: an idle key costs nothing.
Keys share their state's entries with others of their bucket, and rows lie in it by blocks: calls
between Spark and Python grow with buckets and batches, not with keys and rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder

DELAY, LATE_BY = "1 hour", 3600
FILES = 4
PART_ROWS = 1 << 18  # a batch of more rows comes as several files
BUCKETS = 1024  # of keys; a checkpoint's queries must keep to its number
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: From what a key's state holds (none at first) and the time of a row: what it holds then, what
#: the row gets, and until when the state matters. Times are microseconds.
Step = Callable[[int | None, int], tuple[int, int, int]]


def deal_in_files(rows: DataFrame, folder: str, files: int = FILES, late_by: int = LATE_BY, parts: int = 1) -> None:
    """Write rows(ts, event_id, ...) as files, one after the other, in the order of ts but for up to
    late_by seconds, by which rows are late; and a last one whose only row, without a key, is a year later.
    With parts, each is that many files, which files_stream must take together; a row without a key keeps any from being left out."""
    late = rows.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(late_by)) * 1000000)
    first, last, most = late.agg(F.min("_at"), F.max("_at"), F.max("ts")).first()
    if first is None:
        first = last = 0
    step = (last - first) // files + 1
    spark, kinds = rows.sparkSession, rows.schema
    keyless = lambda made, ts: made.select(*[(ts if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds], F.col("id").cast("int").alias("_part"))
    for k in range(files):
        own = late.filter(((F.col("_at") - first) / step).cast("int") == k).withColumn("_part", F.pmod(F.hash("event_id"), F.lit(parts))).drop("_at")
        if parts > 1:
            own = own.unionByName(keyless(spark.range(parts), F.timestamp_micros(F.lit(first + k * step - late_by * 1000000))))
        own.repartitionById(parts, F.col("_part")).drop("_part").write.mode("append").parquet(folder)  # together the input of one batch
    keyless(spark.range(1).coalesce(1), F.lit(most) + F.expr("interval 1 year")).drop("_part").write.mode("append").parquet(folder)


def event_stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The events table's event_id, ts and columns as a stream of several batches in some disorder, with ts as a timestamp that watermarks accept."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", *columns)
    folder = f"{shared_folder(spark)}/marlstone-events-{uuid.uuid4().hex}"
    parts = max(1, min(spark.sparkContext.defaultParallelism, events.count() // (FILES * PART_ROWS)))
    deal_in_files(events, folder, parts=parts)
    return files_stream(spark, folder, events.schema, parts)


def files_stream(spark: SparkSession, folder: str, schema, parts: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, `parts` files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def to_end(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there into a table of the shared folder, and read that."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/marlstone-stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def packed(rows: pa.Table) -> bytes:
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, rows.schema) as writer:
            writer.write_table(rows)
        return out.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def numbered(rows: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's key, and for each number a row that has the key."""
    number = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        found = rows[k].combine_chunks().dictionary_encode(null_encoding="encode")
        _, number = np.unique(number * (len(found.dictionary) + 1) + found.indices.to_numpy(), return_inverse=True)
    _, at, number = np.unique(number, return_index=True, return_inverse=True)
    return number, at


class InOrder(StatefulProcessor):
    """A step for each row (at, id) of a key, in the order of time, and of id among equals. A bucket of keys has one
    timer: when its next row can be taken, or a key's state says nothing any more."""

    def __init__(self, step: Step, keys: list[str], result: str):
        self.step, self.keys, self.result = step, keys, result
        self.rows = pa.schema([*[(k, pa.string()) for k in keys], ("at", pa.int64()), ("id", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.held = handle.getValueState("held", "block binary")

    def wake(self, micros: int) -> None:
        """At the first millisecond that isn't before."""
        at = -(-micros // 1000)
        set_for = list(self.handle.listTimers())
        if not set_for or at < min(set_for):
            for other in set_for:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        blocks, first = [], None
        for frame in rows:
            new = frame[~frame["keyless"].to_numpy(bool)]
            if len(new):
                blocks.append((packed(pa.Table.from_arrays([pa.array(new[f.name].to_numpy(), f.type, from_pandas=True) for f in self.rows], schema=self.rows)),))
                first = int(new["at"].min()) if first is None else min(first, int(new["at"].min()))
        if blocks:
            self.waiting.appendList(blocks)
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pa.concat_tables([unpacked(b) for (b,) in self.waiting.get()] if self.waiting.exists() else [self.rows.empty_table()])
        state = {}
        if self.held.exists():
            *names, value, until = unpacked(self.held.get()[0]).to_pydict().values()
            state = dict(zip(zip(*names, strict=True), zip(value, until, strict=True), strict=True))
        now = rows["at"].to_numpy() <= passed
        ready, left = rows.filter(pa.array(now)), rows.filter(pa.array(~now))
        out = self.taken(ready, state) if ready.num_rows else None
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        if ready.num_rows:
            self.waiting.clear()
            if left.num_rows:
                self.waiting.put([(packed(left),)])
        state = {k: held for k, held in state.items() if held[1] > passed}
        if state:
            names, (value, until) = zip(*state, strict=True), zip(*state.values(), strict=True)
            self.held.update((packed(pa.table([*[pa.array(n, pa.string()) for n in names], pa.array(value, pa.int64()), pa.array(until, pa.int64())], [*self.keys, "value", "until"])),))
        else:
            self.held.clear()
        following = [*([int(left["at"].to_numpy().min())] if left.num_rows else []), *([min(until)] if state else [])]
        if following:
            self.wake(min(following))
        if out is not None:
            yield out

    def taken(self, rows: pa.Table, state: dict) -> pd.DataFrame:
        """Steps over rows, which bring state, by key (value, until), up to date."""
        number, at = numbered(rows, self.keys)
        order = np.lexsort((rows["id"].to_numpy(), rows["at"].to_numpy(), number))
        names = list(zip(*(rows[k].take(pa.array(at)).to_pylist() for k in self.keys), strict=True))
        step, of, value, until, given = self.step, -1, None, None, np.empty(rows.num_rows, np.int64)
        for i, (k, t) in enumerate(zip(number[order].tolist(), rows["at"].to_numpy()[order].tolist(), strict=True)):
            if k != of:
                if of >= 0:
                    state[names[of]] = value, until
                of, value = k, state.get(names[k], (None, None))[0]
            value, given[i], until = step(value, t)
        state[names[of]] = value, until
        out = rows.take(pa.array(order))
        return pd.DataFrame({**{k: out[k].to_numpy() for k in self.keys}, "id": out["id"].to_numpy(), self.result: given})


def as_text(column: str, kind: str) -> Column:
    return F.hex(column) if kind == "binary" else F.unix_micros(column).cast("string") if kind == "timestamp" else F.col(column).cast("string")


def from_text(column: str, kind: str) -> Column:
    return F.unhex(column) if kind == "binary" else F.timestamp_micros(F.col(column).cast("long")) if kind == "timestamp" else F.col(column).cast(kind)


def folded(stream: DataFrame, keys: list[str], step: Step, result: str, delay: str = DELAY) -> DataFrame:
    """Each row of stream(*keys, ts, id) with what its step gives, as a long: (*keys, id, result)."""
    kinds = dict(stream.dtypes)
    texts = [as_text(k, kinds[k]).alias(k) for k in keys]  # which may be null, where pandas makes other types of numbers
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    rows = stream.withWatermark("ts", delay).select(bucket, "ts", *texts, F.unix_micros("ts").alias("at"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("keyless"))
    schema = ", ".join([f"{k} string" for k in keys] + ["id long", f"{result} long"])
    out = rows.groupBy("_bucket").transformWithStateInPandas(InOrder(step, keys, result), schema, "append", "eventtime")
    return out.select(*[from_text(k, kinds[k]).alias(k) for k in keys], "id", result)


def monthly_usage(calls: DataFrame) -> DataFrame:
    """Of a stream calls(provider, ts), the number by provider and month: counted by day, so that the watermark
    closes days and their state goes, and summed into months from the days' latest counts."""
    days = calls.filter("provider is not null").withWatermark("ts", "1 day").groupBy("provider", F.window("ts", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    latest = to_end(days, "update", "usage").groupBy("provider", "day").agg(F.max("calls").alias("calls"))
    return latest.groupBy("provider", F.date_format("day.start", "yyyy-MM").alias("month")).agg(F.sum("calls").alias("calls"))


def cache_step(seconds: float) -> Step:
    """Whether a cache answers (1), whose window only a miss opens; a window says nothing once it is over."""
    width = int(seconds * 1e6)

    def step(opened: int | None, at: int) -> tuple[int, int, int]:
        hit = opened is not None and at < opened + width
        now = opened if hit else at
        return now, int(hit), now + width  # type: ignore[return-value,operator]

    return step


def throttle_step(gap_micros: int) -> Step:
    """When a call starts, `gap_micros` after the one before at least; the next start says nothing once it is past."""

    def step(free: int | None, at: int) -> tuple[int, int, int]:
        start = at if free is None else max(at, free)
        return start + gap_micros, start, start + gap_micros

    return step


def cached_requests(requests: DataFrame, keys: list[str], seconds: float, delay: str = DELAY) -> DataFrame:
    """Of a stream requests(*keys, ts, id), each with `hit`."""
    return to_end(folded(requests, keys, cache_step(seconds), "hit", delay), "append", "cache").withColumn("hit", F.col("hit") == 1)


def throttled(calls: DataFrame, keys: list[str], gap_micros: int, delay: str = DELAY) -> DataFrame:
    """Of a stream calls(*keys, ts, id), when each starts: `start`, in microseconds."""
    return to_end(folded(calls, keys, throttle_step(gap_micros), "start", delay), "append", "throttle")
