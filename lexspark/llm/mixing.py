"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.session import cut

#: Weights of the sources in code-point order, null last; repeated.
WEIGHTS = (5, 2, 1)
#: Most epochs of a source.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of a document's hash that name its bucket: the share 16**-4 of a source is ordered row by row.
BUCKET_DIGITS = 4
WORDS = r"[^\x20\x09-\x0D]+"

_NEW = ("size", "source_size", "target", "repetitions", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row for each source.

    All source sizes together are shared by weight; a target stops at max_epochs times its source's size, and the
    excess goes to the others by weight until none is above. Solved in one pass: in the order of cap / weight, the
    first source whose cap is not below its share of what the capped ones before it leave, and all after it, share
    that rest. The table has a row for each source, not for each document.
    """
    place = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    weighed = sizes.withColumn("weight", cycle.cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("left", left).withColumn("rest", rest)
    level = level.withColumn("free", F.col("cap").cast("double") * F.col("rest") >= F.col("left").cast("double") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "rest"))).over(every)
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("free"), F.col("weight") * F.col("first.left") / F.col("first.rest"))
        .otherwise(F.col("cap").cast("double"))
        .alias("target"),
    )


def _filled(parts: DataFrame) -> DataFrame:
    """(source, at, own, need, start) with before (start and what the source's earlier parts hold) and fits."""
    upto = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("own").over(upto), F.lit(0))
    return parts.withColumn("before", before).withColumn("fits", F.col("before") + F.col("own") <= F.col("need"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """docs with size, source_size, target, repetitions (double, 0 to max_epochs) and taken (long, words).

    size counts words, runs of other than space and \\t to \\r; null text: 0. Each document of a source is taken
    floor(target / source_size) times; the rest of the target goes, once more, to documents in the order of
    md5(seed and id), then size, and the document in which it runs out is taken in part, from its first word on. So a
    source's taken words miss its target by less than a word, and reruns and other partitions agree. Null source: a source of its own,
    last. Null id: hashed as the empty text. Rows of one id and size: taken alike (a word each may be lost). A source or table without words:
    target 0, nothing taken. Columns of docs named like the new ones are replaced.

    The order of a source is cut by sums over parts of the hash, in two steps of at most 256 parts a source; only the
    bucket in which the rest runs out, about 16**-BUCKET_DIGITS of the source, is ordered row by row. What a row needs
    to know is then one row for its source.
    """
    keep = [c for c in docs.columns if c.lower() not in _NEW]
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = docs.select(F.col(source).alias("source"), words.alias("size"), hashed.alias("key"))
    sized = cut(sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = targets(by_source, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("int"))
    goal = cut(goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    same = F.col("g.source").eqNullSafe(F.col("d.source"))
    # sums over the hash's first digits, at most 256 a source, lead to the part in which a source's rest runs out, and
    # sums over the next digits within that part alone to the bucket
    head = F.substring("bucket", 1, BUCKET_DIGITS // 2)
    heads = buckets.groupBy("source", head.alias("at")).agg(F.sum("bucket_size").alias("own"))
    heads = cut(_filled(heads.alias("d").join(goal.alias("g"), same).select("d.source", "at", "own", "need", F.lit(0).cast("long").alias("start"))), "heads")
    over = heads.where("not fits and before < need").select("source", F.col("at").alias("head"), "need", "before")
    inner = buckets.withColumn("head", head).alias("d").join(over.alias("g"), same & (F.col("d.head") == F.col("g.head")))
    inner = cut(_filled(inner.select("d.source", F.col("bucket").alias("at"), F.col("bucket_size").alias("own"), "need", F.col("before").alias("start"))), "buckets")
    whole_heads = heads.where("fits").select("source", F.concat("at", F.lit("f" * (BUCKET_DIGITS - BUCKET_DIGITS // 2))).alias("at"))
    full = whole_heads.union(inner.where("fits").select("source", "at")).groupBy("source").agg(F.max("at").alias("last_full"))
    last = inner.where("not fits and before < need").withColumnRenamed("at", "bucket")
    inside = W.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    cutoff = (
        sized.alias("d")
        .join(last.alias("g"), same & (F.col("d.bucket") == F.col("g.bucket")))
        .groupBy("d.source", "d.bucket", "key", "size", "need", "before")
        .agg(F.sum("size").alias("words"))
        .withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .withColumn("short", F.col("need") - (F.col("before") + F.col("ahead")))
        .where("short > 0 and short <= words")
        .select("source", "key", F.col("size").alias("key_size"), (F.col("short") / F.col("words")).alias("part"))
    )
    plan = goal.alias("d").join(full.alias("g"), same, "left").select("d.*", "last_full")
    plan = cut(plan.alias("d").join(cutoff.alias("g"), same, "left").select("d.*", "key", "key_size", "part"), "plan")
    plan = plan.withColumnsRenamed({"key": "cut_key", "key_size": "cut_size"})
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    marked = docs.select(*keep, words.alias("size"), hashed.alias("__key"))
    marked = marked.join(plan, F.col(source).eqNullSafe(F.col("__source")))
    here, there = F.struct("__key", "size"), F.struct(F.col("__cut_key").alias("__key"), F.col("__cut_size").alias("size"))
    extra = (
        F.when(F.col("__need") <= 0, 0.0)
        .when(F.substring("__key", 1, BUCKET_DIGITS) <= F.col("__last_full"), 1.0)
        .when(F.col("__cut_key").isNull() | (here > there), 0.0)
        .when(here < there, 1.0)
        .otherwise(F.col("__part"))
    )
    marked = marked.withColumn("__extra", extra)
    return marked.select(
        *keep, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__whole") + F.col("__extra")).alias("repetitions"),
        (F.col("size") * F.col("__whole") + F.floor(F.col("size") * F.col("__extra"))).alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their repetitions."""
    return mix(docs).where("repetitions > 0")
