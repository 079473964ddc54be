"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

#: Bytes of input for a partition of dealt(), most of its partitions, and bytes from which Spark doesn't know a size.
PART, MOST_PARTS, UNKNOWN = 8_000_000, 100_000, 10**17

#: Settings for a session of our own; a cluster's submitted settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without spark.checkpoint.dir gets one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "lexspark-shared")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lexspark/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete what cut() has written in this application; results that were not yet computed are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for files of another format than cut()'s; sweep() deletes it too."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def parts(df: DataFrame, makes: int = 1) -> int:
    """Partitions for work on df that makes `makes` times as many rows as words: one for each PART / makes bytes of what it reads, no fewer than the session's, which also serve rows of unknown size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= UNKNOWN else max(least, min(-(-size * makes // PART), MOST_PARTS))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys for work that makes many times its bytes, into as many partitions as parts() says.

    The number is set, as Spark joins partitions of a size that suits rows that stay what they are.
    """
    return df.repartition(parts(df), *keys)


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later stages neither recompute it nor depend on one executor.

    The files also give the planner true sizes, so that Spark broadcasts the result only below its own limit. A
    compression (zstd for texts, say) replaces the session's.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
