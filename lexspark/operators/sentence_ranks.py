"""Different sentences with the ranks of their words: words go to their ranks with a number, not with their sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut

#: What a word's place is multiplied by in the number that also holds its rank.
_PLACE = 1 << 33


def with_ranks(rows: DataFrame, ranks: DataFrame, least: int, most: int) -> DataFrame:
    """(key, ranks) of sentences (key, tokens) of `least` to `most` words, each key once; ranks: of its words in order, null without one.

    key: the tokens joined by spaces. A sentence's text is shuffled twice and written twice, whatever the number of its
    words, which carry its number and their place alone.
    """
    own = rows.where(F.size("tokens").between(least, most)).select("key").distinct()
    own = cut(own.withColumn("id", F.monotonically_increasing_id()), "different", "zstd")
    each = own.select("id", F.posexplode(F.split("key", " ")).alias("i", "word")).join(ranks, "word", "left")
    packed = F.col("i").cast("long") * _PLACE + F.coalesce(F.col("rank").cast("long") + 1, F.lit(0))
    lists = each.select("id", packed.alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    own = own.join(lists, "id").select("key", F.transform("all", lambda x: F.nullif(x % _PLACE, F.lit(0)).cast("int") - 1).alias("ranks"))
    return cut(own, "with-ranks", "zstd")
