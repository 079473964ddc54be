"""Content-addressed identity, competing claims, registries and set merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def surface_id(surface: Column) -> Column:
    """Eight hex digits for a surface."""
    return F.substring(F.md5(F.concat(F.lit("surface/v2:"), surface).cast("binary")), 1, 8)


def example_id(target: Column, english: Column) -> Column:
    """Twelve hex digits for a pair of lines, case and outer spaces apart."""
    return F.substring(F.sha2(F.concat(F.lower(F.trim(target)), F.lit("\0"), F.lower(F.trim(english))), 256), 1, 12)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 24 hex digits of the canonical JSON array of string parts."""
    array = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(array, 256), 1, 24))


def least_prefix_id(rows: DataFrame, group: list[str], content: Column, order: list[str], least: int = 3) -> DataFrame:
    """rows with sense_id: in their order, each takes the shortest prefix (of at least `least` digits) of its content's MD5
    that no earlier row of its group has. Rows of one content share an id.

    A group is one word's senses; they are folded in one row for each group.
    """
    keyed = rows.withColumn("__md5", F.md5(content.cast("binary")))
    once = keyed.groupBy(*group, "__md5").agg(F.min(F.struct(*order)).alias("__o"))
    sets = once.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__md5"))), lambda s: s["__md5"]).alias("__all"))
    taken = F.expr(
        f"""aggregate(__all, cast(map() as map<string,string>), (ids, h) -> map_concat(ids, map(
            coalesce(filter(transform(sequence({least}, 31), n -> substring(h, 1, n)), p -> not map_contains_key(ids, p))[0], h), h)))"""
    )
    ids = sets.select(*group, F.explode(taken).alias("sense_id", "__md5"))
    return keyed.join(ids, [*group, "__md5"]).drop("__md5")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of a text; signature() shows it."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    codes = F.transform(F.regexp_extract_all(units, F.lit("(.{4})"), F.lit(1)), lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(
        codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(4294967296).cast("long"))
    )


def signature(text: Column) -> Column:
    """fnv1a as eight hex digits."""
    return F.lower(F.lpad(F.hex(fnv1a(text)), 8, "0"))


def resolve_claims(claims: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """The winning claim of each layer and subject: not retracted, confident enough, then priority, run and id decide."""
    gone = claims.select(F.explode("supersedes").alias("claim_id"))
    left = claims.join(gone, "claim_id", "left_anti").where((F.col("operation") != "retract") & (F.coalesce("confidence", F.lit(1.0)) >= least_confidence))
    order = W.partitionBy("layer", "subject").orderBy(F.desc("priority"), F.desc("run_id"), F.desc("claim_id"))
    return left.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def best_by_priority(rows: DataFrame, key: list[str], priority: str, ordinal: str) -> DataFrame:
    """One row for each key: the highest priority, of equals the first."""
    order = W.partitionBy(*key).orderBy(F.desc(priority), ordinal)
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's only best."""
    tops = pairs.withColumn("__l", F.max(score).over(W.partitionBy(left))).withColumn("__r", F.max(score).over(W.partitionBy(right)))
    tops = tops.withColumn("__ln", F.count_if(F.col(score) == F.col("__l")).over(W.partitionBy(left)))
    tops = tops.withColumn("__rn", F.count_if(F.col(score) == F.col("__r")).over(W.partitionBy(right)))
    return tops.where(f"{score} = __l and {score} = __r and __ln = 1 and __rn = 1").drop("__l", "__r", "__ln", "__rn")


def nearest_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, a, b): pairs of left (scope, l, a) and right (scope, r, b) of one scope that decide who is whose only nearest by |a - b|.

    Each row meets the two next of the other side below and above it, so that its nearest one is among them and so is
    any other as near, also after rounding. Of rows of one side, scope and value two stand for all: none is an only
    nearest. Pairs grow with the rows, not with their product, and a scope holds no more rows than twice its values.
    Rows without a value have no pairs.
    """

    def two(rows: DataFrame, key: str, value: str) -> DataFrame:
        ends = rows.where(f"scope is not null and {value} is not null").groupBy("scope", F.col(value).alias("v")).agg(F.min(key).alias("x"), F.max(key).alias("y"))
        return ends.select("scope", "v", F.explode(F.array_distinct(F.array("x", "y"))).alias("k"))

    up, down = W.partitionBy("scope").orderBy("v", "k"), W.partitionBy("scope").orderBy(F.desc("v"), F.desc("k"))

    def met(own: DataFrame, other: DataFrame) -> DataFrame:
        """(k, v, at) with at: (k, v) of up to two rows of the other side on each side of a row."""
        lists = other.select("scope", "v", "k", *[F.array(*[F.struct(F.lag("k", i).over(w).alias("k"), F.lag("v", i).over(w).alias("v")) for i in (0, 1)]).alias(n) for n, w in (("low", up), ("high", down))])
        both = own.select("scope", "v", F.lit(0).alias("side"), F.col("k").alias("own"), F.lit(None).alias("low"), F.lit(None).alias("high"))
        both = both.union(lists.select("scope", "v", F.lit(1), F.lit(None), "low", "high"))
        order = ["v", "side", "own"], [F.desc("v"), F.desc("side"), F.desc("own")]
        ways = [F.last(c, ignorenulls=True).over(W.partitionBy("scope").orderBy(*o).rowsBetween(W.unboundedPreceding, 0)) for c, o in zip(("low", "high"), order, strict=True)]
        near = both.select("side", "own", "v", *[F.coalesce(w, F.expr("array()")).alias(n) for w, n in zip(ways, ("below", "above"), strict=True)]).where("side = 0")
        return near.select("own", "v", F.explode(F.concat("below", "above")).alias("at")).where("at.k is not null")

    a, b = two(left, "l", "a"), two(right, "r", "b")
    one = met(a, b).select(F.col("own").alias("l"), F.col("at.k").alias("r"), F.col("v").alias("a"), F.col("at.v").alias("b"))
    two_ = met(b, a).select(F.col("at.k").alias("l"), F.col("own").alias("r"), F.col("at.v").alias("a"), F.col("v").alias("b"))
    return one.union(two_).distinct()


def append_only(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """store and those rows of new whose key it hasn't; of new rows of one key the first by all columns."""
    fresh = new.join(store, key, "left_anti")
    order = W.partitionBy(key).orderBy(*[c for c in fresh.columns if c != key])
    fresh = fresh.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return store.unionByName(fresh)


def changeset(local: DataFrame, remote: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key and change (insert, update or delete) that turn remote into local; equal rows don't appear."""
    both = local.alias("l").join(remote.alias("r"), key, "full_outer")
    here, there = (reduce(lambda a, b: a | b, (F.col(f"{s}.{f}").isNotNull() for f in fields)) for s in "lr")
    differ = reduce(lambda a, b: a | b, (~F.col(f"l.{f}").cast("string").eqNullSafe(F.col(f"r.{f}").cast("string")) for f in fields))
    change = F.when(here & ~there, "insert").when(~here & there, "delete").when(differ, "update")
    return both.select(*key, change.alias("change")).where("change is not null")
