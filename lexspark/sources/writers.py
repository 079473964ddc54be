"""Writers: canonical JSON lines, split decks, content-addressed runs, version stamps, shards, manifests (SNK01-08)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> Column:
    """A row as compact JSON with its columns in order of name; nulls are left out."""
    return F.to_json(F.struct(*sorted(df.columns)))


def write_jsonl(df: DataFrame, path: str, key: str) -> tuple[int, str]:
    """SNK01: canonical JSON lines ordered by key; returns their number and a digest of all lines' digests.

    Spark's commit protocol makes the write atomic; the digest is a sum, so that no task sees all lines.
    """
    lines = df.select(F.col(key).alias("__key"), canonical_json(df).alias("value"))
    lines.orderBy("__key", "value").select("value").write.text(path)
    parts = [F.sum(F.conv(F.substring(F.sha2("value", 256), i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in (1, 13, 25)]
    row = df.sparkSession.read.text(path).agg(F.count("*").alias("n"), *parts).first()
    return row["n"], "-".join(f"{int(row[f'p{i}'] or 0):x}" for i in (1, 13, 25))


def write_split(cards: DataFrame, index_path: str, examples_path: str) -> None:
    """SNK02: cards (card, pos, sense, examples) as an index with senses in order and examples aligned to them."""
    grouped = cards.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("pos", "sense", "examples"))).alias("s"))
    grouped.select("card", F.col("s.sense").alias("senses")).write.json(index_path)
    grouped.select("card", F.col("s.examples").alias("m")).write.json(examples_path)


def archive(df: DataFrame, root: str, run: str) -> str:
    """SNK03: an immutable run; its folder must not exist. Returns its path; latest() finds it."""
    path = f"{root}/runs/{run}"
    df.write.mode("errorifexists").parquet(path)
    stamp = df.sparkSession.createDataFrame([(run, path)], "run string, path string").withColumn("at", F.current_timestamp())
    stamp.coalesce(1).write.mode("append").json(f"{root}/pointer")
    return path


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The run that was archived last."""
    row = spark.read.schema("run string, path string, at timestamp").json(f"{root}/pointer").orderBy(F.desc("at"), F.desc("run")).first()
    return spark.read.parquet(row["path"])


def write_sidecar(spark: SparkSession, path: str, step: str, version: int) -> None:
    """SNK04: a version stamp beside an artifact."""
    spark.createDataFrame([(json.dumps({"step": step, "step_version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def read_version(spark: SparkSession, path: str) -> int:
    """The stamp's version; 0 without a readable one."""
    try:
        row = spark.read.text(f"{path}.meta").select(F.get_json_object("value", "$.step_version").cast("int")).first()
    except Exception as error:  # a missing path has no class of its own in every store
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0
    return (row[0] or 0) if row else 0


def write_shards(df: DataFrame, path: str, rank: str, size: int) -> None:
    """SNK05: rows in folders shard=floor((rank - 1) / size), each one file in order of rank."""
    shard = F.floor((F.col(rank) - 1) / size).cast("int")
    df.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", rank).write.partitionBy("shard").parquet(path)


def manifest(spark: SparkSession, glob: str) -> DataFrame:
    """SNK08: (path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
