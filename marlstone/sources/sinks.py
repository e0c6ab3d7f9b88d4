"""Report, usage and request-log sinks. All of them append or write whole folders, so that
several writers don't overwrite each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators.routing import LIMITS

CALLS = "provider string, ts timestamp"
REQUESTS = "ts timestamp, query string, filters string, hits int, ms double, urls array<string>"


def write_report(report: DataFrame, folder: str, cases: DataFrame | None = None) -> None:
    """A one-row report as JSON with a UTC stamp, and its cases beside it."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    report.withColumn("written_utc", stamp).coalesce(1).write.mode("overwrite").json(f"{folder}/report")  # one row
    if cases is not None:
        cases.write.mode("overwrite").json(f"{folder}/cases")


def count_calls(calls: DataFrame, folder: str) -> None:
    """Add calls(provider, ts) to the usage log."""
    calls.select(F.col("provider").cast("string").alias("provider"), F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(folder)


def usage_log(spark: SparkSession, folder: str) -> DataFrame:
    """All calls so far; none where nothing was written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CALLS).parquet(folder) if there else spark.createDataFrame([], CALLS)


def usage_now(calls: DataFrame, month: Column, limits: dict[str, tuple[int | None, str]] = LIMITS) -> DataFrame:
    """Every known provider's calls that count now: of the month, or ever for one-time limits; providers without calls have 0."""
    known = calls.sparkSession.createDataFrame([(k, n, t) for k, (n, t) in limits.items()], "provider string, call_limit long, type string")
    own = calls.groupBy("provider").agg(F.count_if(F.date_format("ts", "yyyy-MM") == month).alias("in_month"), F.count(F.lit(1)).alias("ever"))
    used = F.when(F.col("type") == "one-time", F.col("ever")).otherwise(F.col("in_month"))
    return known.join(own, "provider", "left").select("provider", F.coalesce(used, F.lit(0)).cast("long").alias("calls"), "call_limit", "type")


def log_requests(requests: DataFrame, folder: str) -> None:
    """Append requests(ts, query, filters, hits, ms, urls) to the request log, as JSON lines."""
    requests.select(*[F.col(c).cast(t) for c, t in (x.strip().split(" ") for x in REQUESTS.split(", "))]).write.mode("append").json(folder)


def audio_file(text: Column, folder: str) -> Column:
    """Where the audio of a text belongs: the same text has the same file."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), content_id(text), F.lit(".wav"))
