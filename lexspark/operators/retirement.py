"""Greedy retirement of near-duplicate vectors: in order, an item goes to the first kept one that is near; by blocks, not one by one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexspark.session import cut

#: Items of a group that a round decides among themselves, items that meet the kept ones of a round in one task, and rows of one product.
BLOCK, ROWS, SLICE = 4096, 8192, 512


@F.pandas_udf(DoubleType())
def cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    """Cosine of pairs of vectors; of one without a length: 0."""
    if not len(left):
        return pd.Series([], dtype=float)
    a, b = (np.stack([np.asarray(v, float) for v in side]) for side in (left, right))
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return pd.Series(np.divide((a * b).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0))


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of x with each of y is the threshold or more; a vector without a length has 0."""
    a, b = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    size = a[:, None] * b[None, :]
    found = np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size > 0)
    # a product of matrices adds up in an order of its own: what lies within rounding is worked out as a single pair is
    i, j = np.nonzero((np.abs(found - threshold) < 1e-9) & (size > 0))
    found[i, j] = (x[i] * y[j]).sum(axis=1) / size[i, j]
    return found >= threshold


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def _decide(rows: DataFrame, threshold: float) -> DataFrame:
    """(g, o, host) of (g, o, v, k), few enough in a group: one after another by k, each to the first kept one near it, or kept."""
    kinds = dict(rows.dtypes)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("k", ignore_index=True)
        x = _stack(block["v"])
        host = np.full(len(x), -1)
        for i in range(len(x)):
            if host[i] < 0:
                free = i + np.nonzero(host[i:] < 0)[0]
                host[free[_near(x[free], x[i : i + 1], threshold)[:, 0]]] = i
                host[i] = i
        return pd.DataFrame({"g": block["g"], "o": block["o"], "host": block["o"].to_numpy()[host]})

    return rows.groupBy("g").applyInPandas(run, f"g {kinds['g']}, o {kinds['o']}, host {kinds['o']}")


def _meet(rest: DataFrame, kept: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(g, o, v, host): rest (g, o, v) with the first by k of kept (g, o, v, k) of their group that is near; none: null.

    The kept ones of a round, BLOCK at most, go to each of the parts into which a group's rest is dealt.
    """
    kinds = dict(rest.dtypes)

    def run(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        kept = kept.sort_values("k", ignore_index=True)
        host = [None] * len(own)
        if len(own) and len(kept):
            y, hosts = _stack(kept["v"]), kept["o"].tolist()
            for at in range(0, len(own), SLICE):
                near = _near(_stack(own["v"].iloc[at : at + SLICE]), y, threshold)
                for i in np.nonzero(near.any(axis=1))[0]:
                    host[at + i] = hosts[near[i].argmax()]
        return pd.DataFrame({"g": own["g"], "o": own["o"], "v": own["v"], "host": pd.Series(host, dtype=object, index=own.index)})

    dealt = rest.select("g", "o", "v", F.pmod(F.xxhash64("o"), F.lit(parts)).alias("part"))
    each = kept.select("g", "o", "v", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    schema = f"g {kinds['g']}, o {kinds['o']}, v {kinds['v']}, host {kinds['o']}"
    return dealt.groupBy("g", "part").cogroup(each.groupBy("g", "part")).applyInPandas(run, schema)


def retire(rows: DataFrame, group: str, item: str, vector: str, order: str, threshold: float, bits: int | None = None) -> DataFrame:
    """(group, item, kept_by): in order, an item is kept, or goes to the first kept one of its group at the cosine or more.

    Not connected components: an item only goes to kept ones. order is unique in a group; vectors have one length. Equal
    vectors stand for their first. Rows without a group or a vector are left out.

    In a round the first BLOCK open items of a group (2 ** bits, if given) are decided one after another, and the rest
    of the group meets those that were kept, in parts of ROWS: retired ones go, the others are open in the next round.
    Exact: an item meets all kept ones in front of it, in their order. No pair is a row. Comparisons grow with a
    group's items times its kept ones; a task holds one block and one part, whatever the group's size.
    """
    kinds = dict(rows.dtypes)
    block = BLOCK if bits is None else 2**bits
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(vector).alias("v"), F.col(order).alias("o")).where("v is not null and g is not null")
    same = own.groupBy("g", "v").agg(F.min_by("item", "o").alias("first"), F.min("o").alias("o"))
    reps = cut(same, "first")
    open_, done = reps.select("g", "o", "v"), []
    while True:
        placed = open_.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy("o")))
        now = placed.where(F.col("k") <= block)
        most = open_.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= block:
            done.append(_decide(now, threshold))
            break
        now = cut(now, "block")
        decided = cut(_decide(now, threshold), "decided")
        kept = now.join(decided.where("o = host").select("g", "o"), ["g", "o"])
        met = cut(_meet(placed.where(F.col("k") > block), kept, threshold, math.ceil(most / ROWS)), "met")
        done += [decided, met.where("host is not null").select("g", "o", "host")]
        open_ = met.where("host is null").select("g", "o", "v")
    links = done[0]
    for more in done[1:]:
        links = links.unionByName(more)
    links = links.join(reps.select("g", F.col("o").alias("host"), F.col("first").alias("kept_by")), ["g", "host"])
    # copies of a vector go where their first goes, and to itself where it is kept
    out = own.join(reps.select("g", F.col("v"), F.col("o").alias("rep")), ["g", "v"]).join(links.withColumnRenamed("o", "rep"), ["g", "rep"])
    return out.select(F.col("g").cast(kinds[group]).alias(group), F.col("item").alias(item), "kept_by")
