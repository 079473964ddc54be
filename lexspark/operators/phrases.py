"""Phrases looked up in token lines by a trie kept as a table of prefixes: level by level, then leftmost and longest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut

#: Fewest and most words of a phrase.
WORDS = (2, 8)


def trie(phrases: DataFrame, most: int) -> DataFrame:
    """(depth, h, phrase): each different prefix of two or more words by its hash, with the phrase that ends there, if one does.

    phrases: phrase, its words separated by one space.
    """
    rows = phrases.select("phrase").distinct().withColumn("w", F.split("phrase", " ")).where(F.size("w").between(WORDS[0], most))
    steps = rows.select("phrase", "w", F.explode(F.sequence(F.lit(WORDS[0]), F.size("w"))).alias("depth"))
    steps = steps.select("depth", F.xxhash64(F.slice("w", F.lit(1), F.col("depth"))).alias("h"), F.when(F.col("depth") == F.size("w"), F.col("phrase")).alias("end"))
    return steps.groupBy("depth", "h").agg(F.collect_set("end").alias("ends"))


def phrase_places(lines: DataFrame, phrases: DataFrame, keys: list[str], most: int = WORDS[1]) -> DataFrame:
    """(keys, i, n, phrase): all places of phrases of two to `most` words in (keys, toks), i from 0.

    A place stays as long as the words from it on are a prefix in the trie, so that places fall away at their first
    words; hashes are only how prefixes meet, a phrase's words are compared in the end. A row for each place and level
    it reaches; nothing is held for a line as a whole. Null or empty lines and phrases of one word have no places.
    """
    nodes = cut(trie(phrases, most), "trie")
    spots = F.expr(f"transform(sequence(0, size(toks) - {WORDS[0]}), i -> struct(i AS i, slice(toks, i + 1, {most}) AS w))")
    at = lines.where(F.size("toks") >= WORDS[0]).select(*keys, F.explode_outer(spots).alias("x")).select(*keys, "x.i", "x.w")
    found = []
    for depth in range(WORDS[0], most + 1):
        level = nodes.where(F.col("depth") == depth).select("h", "ends")
        at = at.where(F.size("w") >= depth).withColumn("h", F.xxhash64(F.slice("w", 1, depth))).join(level, "h").drop("h")
        at = cut(at, "places")
        ended = at.select(*keys, "i", F.lit(depth).alias("n"), F.explode("ends").alias("phrase"), F.array_join(F.slice("w", 1, depth), " ").alias("own"))
        found.append(ended.where("phrase = own").drop("own"))
        at = at.drop("ends")
    return reduce(DataFrame.unionByName, found)


def leftmost_longest(places: DataFrame, keys: list[str]) -> DataFrame:
    """The places of phrase_places that a scan from the left takes: the longest phrase at each free place, then on behind it.

    A line's places are walked in order, each a jump to the next free one: as many as the line has tokens at most.
    """
    longest = places.groupBy(*keys, "i").agg(F.max_by("phrase", "n").alias("phrase"), F.max("n").alias("n"))
    own = longest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "n", "phrase"))).alias("all"))
    start = F.expr("struct(0 AS free, slice(all, 1, 0) AS taken)")
    walk = F.aggregate(
        "all", start,
        lambda acc, x: F.when(x["i"] < acc["free"], acc).otherwise(F.struct((x["i"] + x["n"]).alias("free"), F.concat(acc["taken"], F.array(x)).alias("taken"))),
        lambda acc: acc["taken"],
    )
    return own.select(*keys, F.explode(walk).alias("x")).select(*keys, "x.i", "x.n", "x.phrase")
