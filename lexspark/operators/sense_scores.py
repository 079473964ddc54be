"""Calibrated choice of senses: cosine less a hub offset plus a menu prior; gates and masks; a vote of token prototypes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexspark.operators.retirement import cosine

# Vectors of the background sample and how many of the nearest count; the menu prior and how it falls from
# one sense to the next; the least gap between the two best tuples for a vote.
BACKGROUND, NEAREST = 1200, 40
PRIOR, DECAY = 0.02, 0.5
VOTE_GAP = 0.02


def hub_offsets(background: DataFrame, senses: DataFrame, vector: str = "vector", sample: int = BACKGROUND, nearest: int = NEAREST) -> DataFrame:
    """senses with hub: the mean of its `nearest` highest cosines to a sample of the background's vectors.

    The sample has at most `sample` different vectors, those of least hash, alike on each run; it is what reaches the
    driver and goes out to the tasks. Every sense is measured against it, on its own row. No background: 0.
    """
    own = background.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).distinct()
    rows = [r["v"] for r in own.orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    base = np.array(rows, float)
    if rows:
        size = np.linalg.norm(base, axis=1, keepdims=True)
        base = np.divide(base, size, out=np.zeros_like(base), where=size > 0)

    @F.pandas_udf(DoubleType())
    def hub(vectors: pd.Series) -> pd.Series:
        if not len(base) or not len(vectors):
            return pd.Series(np.zeros(len(vectors)))
        x = np.stack([np.asarray(v, float) for v in vectors])
        size = np.linalg.norm(x, axis=1, keepdims=True)
        scores = np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ base.T
        return pd.Series(np.sort(scores, axis=1)[:, -min(nearest, len(base)) :].mean(axis=1))

    return senses.withColumn("hub", hub(vector))


def choose_senses(
    uses: DataFrame, menu: DataFrame, token_scores: DataFrame, compatible: Column, prior: float = PRIOR, decay: float = DECAY, vote_gap: float = VOTE_GAP
) -> DataFrame:
    """(use, sense, score, tuple_gap, class_gap, gated, masked, voted): the sense of each use of a word.

    uses: use, word, vector, pos (null: not tagged), reflexive (null: no evidence). menu: word, sense, place (from 0),
    lemma, sense_pos, translation, vector, hub. token_scores: use, lemma, sense_pos, token_score, for tuples with a
    prototype. compatible: whether sense_pos fits pos, both columns; asked only of tagged uses.

    score is the cosine less the hub; the choice is by score + prior * decay ** place. In order: where a lemma and the
    same with "se" are both in the menu and there is evidence, senses on its other side fall behind all others; so do
    senses whose part of speech doesn't fit, unless none or all do; the highest, of equals the first of the menu, is
    picked; but where every tuple (lemma, part of speech) of the menu has a token score and the best leads by vote_gap, the
    pick is the best of that tuple. The gaps are those of the plain scores between the pick's tuple (class: part of
    speech and translation) and the best other one, 1 where there is no other. Uses without a menu are left out.
    Windows hold the menu of one word for one use.
    """
    one = W.partitionBy("use")
    lemmas = menu.groupBy("word").agg(F.collect_set("lemma").alias("lemmas"))
    asks = F.exists("lemmas", lambda a: F.array_contains(F.col("lemmas"), F.concat(a, F.lit("se"))))
    senses = menu.join(lemmas, "word").withColumn("ambiguous", asks).drop("lemmas").withColumnRenamed("vector", "u")
    rows = uses.join(senses, "word").withColumn("score", F.coalesce(cosine("vector", "u"), F.lit(0.0)) - F.col("hub")).drop("vector", "u")
    rows = rows.withColumn("grow", F.col("score") + prior * F.pow(F.lit(decay), F.col("place")))
    # evidence for or against "se"
    side = F.col("lemma").endswith("se") == F.col("reflexive")
    gate = F.coalesce(F.col("ambiguous") & F.max(F.coalesce(side, F.lit(False))).over(one), F.lit(False))
    rows = rows.withColumn("gated", gate)
    rows = rows.withColumn("grow", F.when(F.col("gated") & ~side, F.min("grow").over(one) - 1).otherwise(F.col("grow")))
    fits = F.when(F.col("pos").isNotNull(), F.coalesce(compatible, F.lit(False)))
    rows = rows.withColumn("fits", fits).withColumn("masked", F.coalesce(F.max("fits").over(one) & ~F.min("fits").over(one), F.lit(False)))
    rows = rows.withColumn("grow", F.when(F.col("masked") & ~F.col("fits"), F.min("grow").over(one) - 1).otherwise(F.col("grow")))
    keys = ["lemma", "sense_pos"]
    rows = rows.join(token_scores, ["use", *keys], "left")
    tuples = F.struct("token_score", F.struct(*keys).alias("t"))
    best = F.max(tuples).over(one)
    other = F.max(F.when(F.struct(*keys) != best["t"], F.col("token_score"))).over(one)
    whole = F.min(F.col("token_score").isNotNull()).over(one)
    rows = rows.withColumn("best", best).withColumn("voted", F.coalesce(whole & (best["token_score"] - other >= vote_gap), F.lit(False)))
    own = F.when(F.col("voted"), (F.struct(*keys) == F.col("best.t")).cast("int")).otherwise(1)
    rows = rows.withColumn("place_", F.row_number().over(one.orderBy(F.desc(own), F.desc("grow"), "place")))
    picked = [F.max(F.when(F.col("place_") == 1, F.struct(*of))).over(one) for of in (keys, ["sense_pos", "translation"])]
    rows = rows.withColumn("won", picked[0]).withColumn("won_class", picked[1])
    gaps = []
    for name, of, won in (("tuple_gap", keys, "won"), ("class_gap", ["sense_pos", "translation"], "won_class")):
        same = F.struct(*of) == F.col(won)
        gap = F.max(F.when(same, F.col("score"))).over(one) - F.max(F.when(~same, F.col("score"))).over(one)
        gaps.append(F.coalesce(gap, F.lit(1.0)).alias(name))
    columns = reduce(lambda acc, c: [*acc, c], gaps, ["use", "sense", "score"])
    return rows.select(*columns, "gated", "masked", "voted", "place_").where("place_ = 1").drop("place_")
