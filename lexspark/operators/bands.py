"""Study bands: near-equal slices of ranked cards, cut at the nearest drop in frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.numbering import running_sums
from lexspark.session import cut

# Cards a band aims at, fewest and most bands, and the shares of a band for snapping and for its least size.
CARDS, FEWEST, MOST = 200, 10, 80
SNAP, LEAST = 0.25, 0.5


def _round(c: str) -> str:
    return f"CAST(floor({c} + 0.5D) AS BIGINT)"


def study_bands(cards: DataFrame, uses: str) -> DataFrame:
    """(band, start, cards, least_uses, split, coverage) of cards ranked by uses, highest first.

    Between neighbouring bands the aim is an equal number of cards; a drop in frequency within a quarter of a band
    takes the cut, the nearest one, of equals the first, and no band gets less than half its share. Without one the cut
    stays and splits cards of one frequency (split). Only different frequencies are ordered, by ranges. Each of the at
    most 80 cuts looks up the drops next to it on both sides; with 8 cards a band or more no other drop can be nearer
    once the least size binds. Of fewer cards (under 80) all drops are looked at. Null uses count as 0; no cards: no rows.
    """
    counts = cards.groupBy(F.greatest(F.coalesce(F.col(uses), F.lit(0)), F.lit(0)).cast("long").alias("f"))
    counts = counts.agg(F.count("*").alias("n")).withColumn("all", F.col("f") * F.col("n"))
    steps = cut(running_sums(counts, [F.desc("f")], {"ahead": "n", "above": "all"}), "steps")
    shape = steps.agg(F.sum("n").alias("total"), F.sum("all").alias("uses")).where("total > 0")
    shape = shape.withColumn("bands", F.expr(f"least(total, {MOST}, greatest({FEWEST}, ceil(total / {CARDS})))"))
    shape = shape.withColumn("ideal", F.expr(f"transform(sequence(0, bands), k -> {_round('total * k / bands')})"))
    shape = shape.withColumn("snap", F.expr(f"greatest(2, {_round(f'total / bands * {SNAP}')})"))
    shape = F.broadcast(shape.withColumn("least", F.expr(f"greatest(1, {_round(f'total / bands * {LEAST}')})")))  # one row
    # the drops of each gap between two aims that lie next to its ends: for some cards all, else two for each gap
    drops = steps.select((F.col("ahead") + F.col("n")).alias("drop")).join(shape, F.expr("drop < total"))
    drops = drops.withColumn("gap", F.expr(f"IF(total < {FEWEST} * 8, drop, size(filter(ideal, i -> i < drop)))"))
    ends = drops.groupBy("gap").agg(F.array(F.min("drop"), F.max("drop")).alias("ends"))
    ends = ends.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("drops"))
    near = (
        f"filter(drops, d -> d >= {{low}} AND d <= total - (bands - k) * least AND abs(d - {{aim}}) <= snap)"
    )
    low = "(acc[size(acc) - 1] + least)"
    aim = f"greatest({low}, least(total - (bands - k) * least, ideal[k]))"
    best = f"array_min(transform({near.format(low=low, aim=aim)}, d -> struct(abs(d - {aim}) AS far, d AS d))).d"
    fold = f"aggregate(sequence(1, bands), array(0L), (acc, k) -> concat(acc, array(IF(k = bands, total, coalesce({best}, {aim})))))"
    plan = shape.join(F.broadcast(ends), F.lit(True)).withColumn("cuts", F.expr(fold)).select("total", "uses", "cuts")  # one row
    at = steps.withColumnRenamed("n", "own").join(F.broadcast(plan), F.lit(True))
    at = at.withColumn("here", F.expr("filter(transform(cuts, (c, i) -> struct(i AS band, c AS end)), x -> x.band > 0 AND x.end > ahead AND x.end <= ahead + own)"))
    at = at.select("*", F.explode("here").alias("x"))
    return at.select(
        F.col("x.band").alias("band"),
        F.expr("cuts[x.band - 1] + 1").alias("start"),
        F.expr("x.end - cuts[x.band - 1]").alias("cards"),
        F.col("f").alias("least_uses"),
        F.expr("x.end < ahead + own").alias("split"),
        F.expr("round(100 * (above + (x.end - ahead) * f) / uses, 3)").alias("coverage"),
    )
