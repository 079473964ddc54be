"""Vectors and overlaps: scores, prototypes, cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def prototypes(rows: DataFrame, key: list[str], vector: str, least: int) -> DataFrame:
    """key, n and prototype: the mean vector of at least `least` rows, at length one; sums by dimension, no list of rows."""
    each = rows.select(*key, F.posexplode(vector).alias("dim", "x")).groupBy(*key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    means = each.where(F.col("n") >= least).groupBy(*key).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    mean = means.withColumn("v", F.col("v.x"))
    return mean.select(*key, "n", F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("prototype"))


def cue_owners(rows: DataFrame, scope: str, cue: str, owner: str) -> DataFrame:
    """Cues that exactly one owner of their scope has."""
    return rows.groupBy(scope, cue).agg(F.count_distinct(owner).alias("__n"), F.min(owner).alias(owner)).where("__n = 1").drop("__n")


def first_best(rows: DataFrame, key: list[str], score: Column, ties: list[Column]) -> DataFrame:
    """The row of the highest score of each key; of equals the first by ties."""
    w = W.partitionBy(*key).orderBy(score.desc(), *ties)
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")
