"""Ranked selection: bounded bests, greedy covers, islands, cumulative cuts, hashed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators.examples import greedy_cover  # noqa: F401
from lexspark.operators.numbering import numbered, ranked, running_sums  # noqa: F401


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int | Column, name: str = "place") -> DataFrame:
    """The first k rows of each key; k may be an expression. Spark limits each partition before it shuffles (k a number)."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def islands(rows: DataFrame, keys: list[str], order: str, breaks: Column) -> DataFrame:
    """rows with island, the number of breaks up to each row within its keys."""
    return rows.withColumn("island", F.sum(breaks.cast("int")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def hash_priority(seed: str, *parts: Column) -> Column:
    """A value that orders rows at random but always alike: 16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256), 1, 16)


def hash_split(word: Column, percent: int) -> Column:
    """Whether a word falls in the first `percent` of 100 parts by SHA-1."""
    return F.conv(F.substring(F.sha1(word.cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent


def yield_at(rows: DataFrame, score: str, ok: str, share: float, tie: str) -> DataFrame:
    """n and cut: the longest prefix by score in which a share of `share` is right, and its last score.

    The rows are counted by score first; what stands in front of a score is summed by ranges of scores.
    """
    counts = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(ok).cast("long")).alias("good"))
    run = running_sums(counts.withColumn("good", F.coalesce("good", F.lit(0))), [F.desc(score)], {"n_all": "n", "n_good": "good"})
    run = run.withColumns({"n_all": F.col("n_all") + F.col("n"), "n_good": F.col("n_good") + F.col("good")})
    return run.where(F.col("n_good") >= F.col("n_all") * share).agg(
        F.coalesce(F.max("n_all"), F.lit(0)).alias("n"), F.min(score).alias("cut")
    )


def largest_remainder(rows: DataFrame, keys: list[str], total: str, weight: str, order: str) -> DataFrame:
    """rows with part: total split by weight, floors first, then one each by remainder, weight and order.

    Weights that are all zero split evenly, the first rows getting what is left.
    """
    own = W.partitionBy(*keys)
    weights = F.sum(weight).over(own)
    exact = F.when(weights > 0, F.col(total) * F.col(weight) / weights).otherwise(F.col(total) / F.count("*").over(own))
    rows = rows.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    rest = F.col(total) - F.sum("__floor").over(own)
    by = own.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), F.desc(weight), order)
    part = F.col("__floor") + (F.row_number().over(by) <= rest).cast("long")
    return rows.withColumn("part", part).drop("__exact", "__floor")
