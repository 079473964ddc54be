"""Glosses of one word put together as they come (SIM02, SIM03): folds over a word's short list of senses, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import fold_accents

# Words of a gloss that say nothing about its meaning, for proposals and for a dictionary's senses.
PROPOSAL_STOPS = ("a", "an", "and", "for", "of", "or", "slang", "the", "to", "people", "person", "situation", "term", "word")
SENSE_STOPS = (
    "a", "an", "the", "to", "of", "in", "on", "at", "for", "is", "it", "be", "as", "or", "by", "and", "not", "with", "from", "that", "this",
    "but", "are", "was", "were", "been", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might",
    "shall", "should", "up", "out", "if", "so", "no", "into", "over", "also", "its", "one",
)
PROPOSAL_SHARE, SENSE_SHARE = 0.25, 0.3


def proposal_tokens(gloss: Column) -> Column:
    """Folded words without empty ones, plurals cut."""
    toks = F.filter(F.regexp_extract_all(fold_accents(F.coalesce(gloss, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*PROPOSAL_STOPS))
    chop = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    long = lambda t: F.length(t) > 4
    return F.array_distinct(F.transform(toks, lambda t: F.when(long(t) & t.endswith("ies"), F.concat(chop(t, 3), F.lit("y"))).when(
        long(t) & t.endswith("s") & ~t.endswith("ss"), chop(t, 1)).otherwise(t)))


def sense_words(gloss: Column) -> Column:
    """Different ASCII words of two letters or more before any bracket, without empty ones."""
    front = F.lower(F.substring_index(F.coalesce(gloss, F.lit("")), "(", 1))
    return F.array_distinct(F.filter(F.regexp_extract_all(front, F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*SENSE_STOPS) & (F.length(w) > 1)))


def share(a: Column, b: Column) -> Column:
    """Common words over all words of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _fold(rows: Column, empty: Column, meets, join, single) -> Column:
    """Clusters, each row joining the first that it meets, and with it all others that it meets; else it begins one."""

    def step(clusters: Column, row: Column) -> Column:
        met = F.filter(clusters, lambda c: meets(c, row))
        at = F.array_position(F.transform(clusters, lambda c: meets(c, row)), F.lit(True)).cast("int")
        front = F.slice(clusters, F.lit(1), F.greatest(at - 1, F.lit(0)))
        behind = F.filter(F.slice(clusters, F.greatest(at, F.lit(1)), F.size(clusters)), lambda c: ~meets(c, row))
        return F.when(F.size(met) > 0, F.concat(front, F.array(join(met, row)), behind)).otherwise(F.concat(clusters, F.array(single(row))))

    return F.aggregate(rows, empty, step)


def cluster_proposals(rows: DataFrame, key: list[str], gloss: str, order: list[str], item: str) -> DataFrame:
    """SIM03: (key, cluster, item): by length of gloss, then gloss, then order, a row joins the cluster whose words it shares to 0.25.

    A cluster's words grow with each row, so the order matters; a row that meets several joins them. `cluster` counts from 1 in the
    order of a cluster's first place. A key's rows are those of one word and part of speech: few, and read as one list.
    """
    kind = dict(rows.dtypes)[item]
    row = F.struct(F.length(gloss).alias("n"), F.lower(gloss).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(item).alias("item"), proposal_tokens(F.col(gloss)).alias("toks"))
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    one = lambda r: F.struct(r["toks"].alias("toks"), F.array(r["item"]).alias("items"))
    both = lambda met, r: F.struct(
        F.array_union(F.array_distinct(F.flatten(F.transform(met, lambda c: c["toks"]))), r["toks"]).alias("toks"),
        F.concat(F.flatten(F.transform(met, lambda c: c["items"])), F.array(r["item"])).alias("items"),
    )
    empty = F.array().cast(f"array<struct<toks: array<string>, items: array<{kind}>>>")
    found = _fold(F.col("rows"), empty, lambda c, r: share(c["toks"], r["toks"]) >= PROPOSAL_SHARE, both, one)
    return lists.select(*key, F.posexplode(found).alias("c", "v")).select(*key, (F.col("c") + 1).alias("cluster"), F.explode("v.items").alias(item))


def merge_senses(rows: DataFrame, key: list[str], gloss: str, order: str) -> DataFrame:
    """SIM02: (key, order, gloss, senses): senses linked by a share of 0.3 become one, directly or through others.

    Senses without telling words are linked only if their glosses are equal. A merged sense is the longest of its glosses, of equals
    the first, with the terms (between commas) of the others that it lacks; `order` is that of the longest. A key is one word and part
    of speech.
    """
    kind = dict(rows.dtypes)[order]
    row = F.struct(F.col(order).alias("o"), F.coalesce(gloss, F.lit("")).alias("g"), sense_words(F.col(gloss)).alias("w"))
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    alike = lambda a, b: F.when(F.size(a["w"]) + F.size(b["w"]) == 0, F.lower(F.trim(a["g"])) == F.lower(F.trim(b["g"]))).otherwise(share(a["w"], b["w"]) >= SENSE_SHARE)
    empty = F.array().cast(f"array<array<struct<o: {kind}, g: string, w: array<string>>>>")
    found = _fold(F.col("rows"), empty, lambda c, r: F.exists(c, lambda m: alike(m, r)), lambda met, r: F.concat(F.flatten(met), F.array(r)), F.array)
    each = lists.select(*key, F.explode(found).alias("m")).withColumn("m", F.array_sort("m"))
    longest = F.array_max(F.transform("m", lambda x: F.length(x["g"])))
    at = F.array_position(F.transform("m", lambda x: F.length(x["g"])), longest).cast("int")
    base = each.withColumn("b", F.element_at("m", at)).withColumn("others", F.filter("m", lambda x, i: i + 1 != at))
    terms = lambda g: F.transform(F.split(g, ","), lambda t: F.trim(t))
    offered = F.flatten(F.transform("others", lambda x: terms(x["g"])))
    own = F.transform(terms(F.col("b.g")), F.lower)
    fresh = F.filter(offered, lambda t: (t != "") & ~F.array_contains(own, F.lower(t)))
    added = F.aggregate(fresh, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))))
    whole = F.concat(F.array("b.g"), added)
    return base.select(*key, F.col("b.o").alias(order), F.array_join(whole, ", ").alias(gloss), F.size("m").alias("senses"))
