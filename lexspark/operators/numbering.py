"""Numbers and running sums over all rows in one order, by ranges of that order: no task holds more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.session import cut

_LOW = 33  # bits of monotonically_increasing_id() below the partition's number


def _ranged(rows: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """rows in `parts` ranges of the order, each sorted, with __part and __at (from 0 within its range); written once.

    Spark samples the bounds of the ranges over all columns of the order, so that a single value with many rows is
    divided by what orders its rows. The numbers are read off the written rows: a task that runs again cannot change them.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = cut(placed, "ranged")
    return placed.withColumns({"__part": F.shiftright("__id", _LOW), "__at": F.col("__id").bitwiseAND((1 << _LOW) - 1)}).drop("__id")


def _before(placed: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """(__part, names): what the ranges in front of each range hold; a row for each range, so one task is enough."""
    sums = placed.groupBy("__part").agg(*[F.sum(a).alias(f"__own_{name}") for name, a in amounts.items()])
    w = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(f"__own_{name}").over(w), F.lit(0)).alias(f"__before_{name}") for name in amounts]
    return F.broadcast(sums.select("__part", *ahead))  # as many rows as ranges


def numbered(rows: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """rows with their place from 1 in the order. The order should be total; rows that tie in all of it are numbered as they come."""
    placed = _ranged(rows, order, parts)
    out = placed.join(_before(placed, {"n": F.lit(1)}), "__part")
    return out.withColumn(name, F.col("__before_n") + F.col("__at") + 1).drop("__part", "__at", "__before_n")


def numbered_as_written(rows: DataFrame, name: str = "id") -> DataFrame:
    """rows, written once, with numbers from 0 without gaps in the order in which they lie; no row is moved for it."""
    placed = cut(rows.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"__part": F.shiftright("__id", _LOW), "__at": F.col("__id").bitwiseAND((1 << _LOW) - 1)}).drop("__id")
    out = placed.join(_before(placed, {"n": F.lit(1)}), "__part")
    return out.withColumn(name, F.col("__before_n") + F.col("__at")).drop("__part", "__at", "__before_n")


def running_sums(rows: DataFrame, order: list[Column], amounts: dict[str, str], parts: int | None = None) -> DataFrame:
    """rows with, by name, the sum of a column of whole numbers (not null) over all rows in front in a total order; the row's own is not in it."""
    placed = _ranged(rows, order, parts)
    within = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(_before(placed, {name: F.col(c) for name, c in amounts.items()}), "__part")
    sums = {name: F.col(f"__before_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in amounts.items()}
    return out.withColumns(sums).drop("__part", "__at", *[f"__before_{name}" for name in amounts])


def ranked(rows: DataFrame, value: str, tie: str | None, name: str = "rank", parts: int | None = None) -> DataFrame:
    """rows with a rank from 1 by value, highest first, then tie, which tells rows of one value apart.

    tie None: equal values share the first rank; the different values are counted first, and only they are ordered.
    """
    if tie is not None:
        return numbered(rows, [F.desc(value), F.asc(tie)], name, parts)
    values = rows.groupBy(value).agg(F.count("*").alias("__n"))
    ahead = running_sums(values, [F.desc(value)], {name: "__n"}, parts)
    return rows.join(ahead.select(value, (F.col(name) + 1).alias(name)), value)
