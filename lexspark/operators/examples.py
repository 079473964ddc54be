"""Example sentences of words: each adds most neighbours in rank that are not yet covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators.sentence_ranks import with_ranks
from lexspark.session import cut, parts

# Lengths of usable sentences, the length from which words cost easiness and how much, ranks counted as
# neighbours, their most for a tier, ranks of trivial sentences, the rank of a word without one, and greedy_cover's pool.
WORDS, LONG, LONG_COST = (3, 18), 12, 5
NEIGHBOURS, TIERS = 50, 10
TRIVIAL, UNRANKED = 100, 999_999
POOL = 200
# Bits of a sentence's number in the order of all, and of a tier; neighbours in one whole number.
_ORDER, _TIER, _BITS = 54, 4, 62


def sentence_index(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, n, easiness, ranks) of sentences (key, tokens) and (word, rank): the median of their ranks, and the different ranks.

    Sentences of fewer than 3 or more than 18 words, of words of the first ranks alone, or without a ranked word are left out.
    """
    own = with_ranks(rows, ranks, *WORDS)
    every = F.array_sort(F.transform("ranks", lambda r: F.coalesce(r, F.lit(UNRANKED))))
    met = own.select("key", F.size("ranks").alias("n"), every.alias("every"), F.array_sort(F.array_distinct(F.filter("ranks", lambda r: r.isNotNull()))).alias("ranks"))
    easiness = F.expr("floor((every[int((n - 1) / 2)] + every[int(n / 2)]) / 2)")
    return met.where((F.array_max("every") > TRIVIAL) & (F.size("ranks") > 0)).select("key", "n", easiness.alias("easiness"), "ranks")


def _greedy(k: int, parts: str) -> Column:
    """The places of up to k of the candidates `pool`, each with most parts not yet covered, of equals the first."""

    def step(acc: Column, _: Column) -> Column:
        gain = F.transform("pool", lambda c, i: F.struct(F.size(F.array_except(c[parts], acc["covered"])).alias("gain"), (-i).alias("at")))
        best = F.array_max(gain)
        at = -best["at"]
        more = F.struct(F.array_union(acc["covered"], F.get("pool", at)[parts]).alias("covered"), F.concat(acc["taken"], F.array(at)).alias("taken"))
        return F.when(best["gain"] > 0, more).otherwise(acc)

    start = F.struct(F.slice(F.get("pool", F.lit(0))[parts], 1, 0).alias("covered"), F.expr("CAST(array() AS array<int>)").alias("taken"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda acc: acc["taken"])


def greedy_cover(rows: DataFrame, key: str, item: str, parts: str, order: str | list[str], k: int, pool: int = POOL) -> DataFrame:
    """(key, item, place): up to k of the first `pool` items of each key, each adding most parts not yet covered; of equals the first.

    The pool bounds what is held for a key, whatever its number of items: Spark keeps the first of each partition before it
    shuffles. The choice is a fold over the pool, in the JVM. Null parts cover nothing; items of one key and order go by item.
    """
    order = [order] if isinstance(order, str) else order
    place = F.row_number().over(W.partitionBy(key).orderBy(*order, item))
    first = rows.select(key, item, F.coalesce(parts, F.slice(F.col(parts), 1, 0)).alias(parts), *[o for o in order if o not in (key, item, parts)])
    first = first.where(F.col(parts).isNotNull()).withColumn("__at", place).where(F.col("__at") <= pool)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", item, parts))).alias("pool"))
    taken = lists.select(key, "pool", F.posexplode(_greedy(k, parts)).alias("place", "at"))
    return taken.select(key, F.get("pool", F.col("at"))[item].alias(item), (F.col("place") + 1).alias("place"))


def _near(neighbours: int) -> list[Column]:
    """The neighbours of `rank` among `ranks`, a bit for each distance from it, in as many whole numbers as hold them."""
    starts = range(-neighbours, neighbours + 1, _BITS)
    bit = "aggregate(ranks, 0L, (a, r) -> a | CASE WHEN r <> rank AND r - rank BETWEEN {} AND {} THEN shiftleft(1L, r - rank - ({})) ELSE 0L END)"
    return [F.expr(bit.format(at, min(at + _BITS - 1, neighbours), at)).alias(f"near{i}") for i, at in enumerate(starts)]


def cover_examples(index: DataFrame, ranks: DataFrame, k: int, pool: int | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(word, key, place, tier): up to k sentences of each ranked word, chosen to cover words of nearby rank.

    Neighbours of a word in a sentence are the sentence's ranks up to `neighbours` from the word's; the tier is their
    number, 10 at most. Each choice adds most neighbours not yet covered, of equals the first of tier, highest first,
    then easiness plus 5 for each word over 12, then key. A word none of whose sentences has a neighbour gets its
    easiest. All sentences of a word are looked at, or the first `pool` in that order.

    Sentences are numbered once in the order of cost and key, so that gain, tier and order are one whole number, of which
    each round takes the most for each word: a row for each word and partition is shuffled, no list of sentences is held.
    """
    cost = F.col("easiness") + LONG_COST * F.greatest(F.lit(0), F.col("n") - LONG)
    rows = index.select("key", "ranks", cost.alias("cost"))
    order = [F.col("cost"), F.col("key")]
    rows = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order)
    # numbers of partition and place follow the order
    placed = cut(rows.select("key", "ranks", F.monotonically_increasing_id().alias("o")), "in-order", "zstd")
    bits = _near(neighbours)
    names = [f"near{i}" for i in range(len(bits))]
    count = lambda cs: reduce(Column.__add__, [F.bit_count(c) for c in cs])
    near = placed.select("o", "ranks", F.explode("ranks").alias("rank")).select("rank", "o", *bits)
    near = near.withColumn("tier", F.least(count([F.col(c) for c in names]), F.lit(TIERS)))
    if pool is not None:
        at = F.row_number().over(W.partitionBy("rank").orderBy(F.desc("tier"), "o"))
        near = near.withColumn("at", at).where((F.col("at") <= pool) | (F.col("tier") == 0)).drop("at")
    first = (1 << _ORDER) - 1
    value = lambda gain: gain.cast("long") * (1 << _ORDER + _TIER) + F.col("tier").cast("long") * (1 << _ORDER) + (F.lit(first) - F.col("o"))
    found, seen = [], None
    for place in range(1, k + 1):
        if seen is None:
            best = near.select("rank", value(count([F.col(c) for c in names])).alias("best"))
        else:
            gain = count([F.col(c).bitwiseAND(F.bitwise_not(f"seen_{c}")) for c in names])
            # words without a neighbour: their next in order
            best = F.when(F.col("none"), F.when(F.col("o") > F.col("last"), value(F.lit(0)))).otherwise(F.when(gain > 0, value(gain)))
            best = near.join(seen, "rank").select("rank", best.alias("best")).where("best IS NOT NULL")
        best = best.groupBy("rank").agg(F.max("best").alias("best"))
        tier = F.shiftright("best", _ORDER).bitwiseAND((1 << _TIER) - 1).cast("int")
        best = cut(best.select("rank", (F.lit(first) - F.col("best").bitwiseAND(first)).alias("o"), tier.alias("tier")), "best")
        found.append(best.withColumn("place", F.lit(place)))
        if place < k:
            met = best.join(placed.select("o", "ranks"), "o").select("rank", (F.col("tier") == 0).alias("none"), F.col("o").alias("last"), *bits)
            if seen is not None:
                met = met.join(seen.drop("none", "last"), "rank").select("rank", "none", "last", *[F.col(c).bitwiseOR(F.col(f"seen_{c}")).alias(c) for c in names])
            seen = cut(met.withColumnsRenamed({c: f"seen_{c}" for c in names}), "covered")
    taken = cut(reduce(DataFrame.unionByName, found).join(ranks, "rank").select("word", "o", "place", "tier"), "taken")
    return taken.join(placed.select("o", "key"), "o").select("word", "key", "place", "tier")
