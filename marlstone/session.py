"""Session helpers: defaults for local use and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",  # terms of a search reach the scan of the postings
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "8g", name: str = "marlstone") -> SparkSession:
    """A session on this machine, for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cores)}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only where a session on this machine alone names none (a test) is a temporary folder
    set; on a cluster its executors couldn't see it, so that the setting is missed there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts the lineage,
    fixes row placement, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a frame that materialise() made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
