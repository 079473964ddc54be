"""What five filters remove in every order: words exploded and aggregated, flags joined, 32 conditional counts for each part."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Fewest words; least percentage of distinct words; highest percentage of capitals; characters that fail a document.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)


def word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, key, text) to (doc_id, key, total, distinct): words and different words of one row of each id and key.

    Documents are dealt by id and key once; that layout serves both aggregates. An empty word stands for each row, so
    that rows without words stay, and copies of a row are told from uses of a word.
    """
    dealt = rows.repartition("doc_id", "key")
    words = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    each = dealt.select("doc_id", "key", F.explode_outer(words).alias("word")).groupBy("doc_id", "key", "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    sums = [F.sum(F.when(real, F.col("n")).otherwise(0)).alias("all"), F.sum(real.cast("long")).alias("distinct"), F.max(F.when(~real, F.col("n"))).alias("rows")]
    return each.groupBy("doc_id", "key").agg(*sums).select("doc_id", "key", F.expr("all div rows").alias("total"), "distinct")


def failures(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic), a row for each document: mask has bit i set if it fails filter i of A to E."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS * F.length("text")
    flags = cut(
        rows.select("doc_id", "part", "key", F.unhex(F.sha2("text", 256)).alias("digest"), capitals.alias("c"), F.col("text").rlike(MARKS).alias("d")),
        "flags",
    )
    counts = cut(word_counts(rows.select("doc_id", "key", "text")), "counts")
    # the first document of each text, found again by its own id: no text's copies meet in one task
    first = flags.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids have neither labels nor smaller ids; they stay out of the joins on ids
    known = flags.where("doc_id is not null").join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    unknown = flags.where("doc_id is null").withColumns({"first": F.lit(True), "good": F.lit(0), "toxic": F.lit(0)})
    every = known.unionByName(unknown).alias("f")
    every = every.join(counts.alias("w"), F.expr("f.doc_id <=> w.doc_id AND f.key = w.key"), "left")
    fails = (
        F.col("total") < LEAST_WORDS,
        100 * F.col("distinct") < DISTINCT * F.col("total"),
        F.col("c"),
        F.col("d"),
        F.col("first").isNull(),
    )
    mask = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(fails)), F.lit(0))
    return every.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def conditional_counts(marked: DataFrame) -> DataFrame:
    """One row for each part: arrays n, good and toxic with a count for each of the 32 masks."""
    cases = lambda which: [F.count_if((F.col("mask") == m) & which).alias(f"m{m}") for m in range(MASKS)]
    kinds = {"n": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    counts = marked.groupBy("part").agg(*[c.alias(f"{kind}{m}") for kind, which in kinds.items() for m, c in enumerate(cases(which))])
    return counts.select("part", *[F.array(*[F.col(f"{kind}{m}") for m in range(MASKS)]).alias(kind) for kind in kinds])


def _over_masks(counts: str, which: str) -> Column:
    """The sum of the counts of the masks m for which the condition holds."""
    return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (sum, m) -> sum + IF({which}, {counts}[m], 0L))")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """For each part (source; null: empty string), order of the five filters and step: what the step's filter does.

    A document fails A with under 50 words, B with 100 * distinct words < 65 * words, C with 100 * capitals A-Z > 5 *
    code points, D with any of # $ % & * |, and E if a smaller id has the same text (by length-free SHA-256 of all of
    it) anywhere. Null text: empty; a text without words fails A alone of the first four. Null id: no label, and never
    a smaller or larger id. Rows of one id: each counts; of several labels for an id, any 1 counts. Columns: kept after
    the step, removed by it, redundant (failing, but removed before), unique_fails (failing this filter only),
    good_lost and toxic_lost (removed here, labelled quality or toxic 1), shapley (what the filter removes, summed over
    all 120 orders). All follow from 32 counts a part. Empty table: no rows. Other columns of docs don't matter.
    """
    counts = conditional_counts(failures(docs, labels, text, source, doc_id))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    plan = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substr(filter_order, {0}, 1)) - 65)"
    plan = plan.withColumn("own", F.expr(bit.format("step")))
    plan = plan.withColumn("before", F.expr(f"aggregate(slice(sequence(1, 5), 1, step - 1), 0, (b, i) -> b | {bit.format('i')})"))
    here = "m & own != 0 AND m & before = 0"
    return plan.select(
        "part",
        "filter_order",
        "step",
        _over_masks("n", "m & (own | before) = 0").alias("kept"),
        _over_masks("n", here).alias("removed"),
        _over_masks("n", "m & own != 0 AND m & before != 0").alias("redundant"),
        _over_masks("n", "m = own").alias("unique_fails"),
        _over_masks("good", here).alias("good_lost"),
        _over_masks("toxic", here).alias("toxic_lost"),
        # among the filters that a document fails, each comes first in an equal share of the orders
        F.expr(f"aggregate(sequence(1, {MASKS - 1}), 0L, (sum, m) -> sum + IF(m & own != 0, n[m] * (120 div bit_count(m)), 0L))").alias("shapley"),
    )
