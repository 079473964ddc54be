"""Backup sentences: each word takes its easiest sentences, words in order, a sentence at most so often over all words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators.sentence_ranks import with_ranks
from lexspark.session import cut

# Lengths of usable and of preferred sentences, weights of words missing or over, the discount on the
# hardest new word, the rank of a word without one, and the shared word pairs from which two sentences are alike.
WORDS, PREFERRED = (5, 16), (6, 12)
SHORT_WEIGHT, LONG_WEIGHT = 0.60, 0.30
HARDEST = 0.35
UNRANKED = 60_000
ALIKE = 2
PER_WORD, REUSE = 10, 4
#: Candidates of a word that are held as a list; Spark keeps as many of each partition before it shuffles.
HEAD = 200


def sentences(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, tokens) of sentences and (word, rank) to (word, rank, key, total, burden, beyond): what choosing needs.

    key: the tokens joined by spaces, so that sentences that differ in punctuation are one. burden: over the words of
    higher rank than the word, log10 of their rank over its own, the hardest at 0.35; total adds 0.60 for each word
    short of 6 and 0.30 for each over 12. Sentences of fewer than 5 or more than 16 words are left out.
    """
    own = with_ranks(rows, ranks, *WORDS)
    words = F.array_distinct(F.arrays_zip(F.split("key", " ").alias("word"), F.col("ranks").alias("rank")))
    log = lambda x: F.log10(F.greatest(F.coalesce(x["rank"], F.lit(UNRANKED)), F.lit(1)).cast("double"))
    each = own.select("key", F.array_sort(F.transform(words, lambda x: F.struct(log(x).alias("log"), x["word"].alias("word"), x["rank"].alias("rank")))).alias("all"))
    each = each.select("key", "all", F.explode(F.filter("all", lambda x: x["rank"].isNotNull())).alias("me"))
    costs = F.reverse(F.transform(F.filter("all", lambda x: x["log"] > F.col("me.log")), lambda x: x["log"] - F.col("me.log")))
    each = each.select("key", F.col("me.word").alias("word"), F.col("me.rank").alias("rank"), costs.alias("costs"))
    tokens = F.split("key", " ")
    n = F.size(tokens)
    burden = F.when(F.size("costs") > 0, F.expr(f"costs[0] * {HARDEST} + aggregate(slice(costs, 2, 16), 0D, (a, c) -> a + c)")).otherwise(0.0)
    penalty = SHORT_WEIGHT * F.greatest(F.lit(0), PREFERRED[0] - n) + LONG_WEIGHT * F.greatest(F.lit(0), n - PREFERRED[1])
    out = each.withColumn("burden", F.round(burden, 9)).withColumn("total", F.round(F.col("burden") + penalty, 9))
    return out.select("word", "rank", "key", "total", "burden", F.size("costs").alias("beyond"))


def _alike(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) >= ALIKE


def _unlike(per_word: int) -> Column:
    """The first of candidates `open`, in their order, each unlike all picks in front of it."""

    def step(acc: Column, c: Column) -> Column:
        return F.when((F.size(acc) >= per_word) | F.exists(acc, lambda p: _alike(p["pairs"], c["pairs"])), acc).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate("open", F.expr("slice(open, 1, 0)"), step)


def _filled(picks: Column, keys: Column, per_word: int) -> Column:
    """Keys picked and, up to per_word, the first of keys that are none of them."""
    return F.slice(F.concat(picks, F.array_except(keys, picks)), 1, per_word)


def _pairs(key: Column) -> Column:
    """The hashes of a sentence's neighbouring words: made anew, as stored they take more than their sentence."""
    w = F.split(key, " ")
    pairs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    return F.transform(F.array(w), pairs)[0]


_ORDER = ("total", "burden", "beyond", "key")


def _from_rest(words: DataFrame, rest: DataFrame, full: DataFrame | None, per_word: int) -> DataFrame:
    """(word, rank, closed, picks) of (word, rank, closed, open, first): first, the picks among a word's head, carried on among its rest.

    Each pass takes the next candidate of each word: the least in order that is open and unlike all picks; rows meet
    a word's picks, no list of its candidates is held.
    """
    own = rest.join(words.select("word"), "word", "left_semi")
    if full is not None:
        own = own.join(full, "key", "left").where("last IS NULL OR struct(rank, word) <= last")
    own = own.select("word", F.struct(*_ORDER).alias("c"))
    at = F.row_number().over(W.partitionBy("word").orderBy("c"))
    spare = own.withColumn("at", at).where(F.col("at") <= 2 * per_word).groupBy("word").agg(F.array_sort(F.collect_list("c")).alias("spare"))
    picks = words.select("word", "first", F.lit(None).cast(own.schema["c"].dataType).alias("after"), F.lit(False).alias("done"))
    for _ in range(per_word):
        picks = cut(picks, "first")
        met = own.join(picks.where(~F.col("done") & (F.size("first") < per_word)), "word").where("after IS NULL OR c > after")
        met = met.where(~F.exists("first", lambda p: _alike(p["pairs"], _pairs(F.col("c.key")))))
        following = cut(met.groupBy("word").agg(F.min("c").alias("next")), "next")
        if following.isEmpty():
            break
        picks = picks.join(following, "word", "left")
        new = F.array(F.struct(F.col("next.key").alias("key"), _pairs(F.col("next.key")).alias("pairs")))
        more = F.when(F.col("next").isNull(), F.col("first")).otherwise(F.concat("first", new))
        picks = picks.select("word", more.alias("first"), F.coalesce("next", "after").alias("after"), F.col("next").isNull().alias("done"))
    out = words.select("word", "rank", "closed", "open").join(picks.select("word", "first"), "word").join(spare, "word", "left")
    keys = F.concat("open", F.coalesce("spare.key", F.expr("CAST(array() AS array<string>)")))
    return out.select("word", "rank", "closed", _filled(F.col("first.key"), keys, per_word).alias("picks"))


def choose(candidates: DataFrame, per_word: int = PER_WORD, reuse: int = REUSE, head: int = HEAD, rounds: int = 200) -> DataFrame:
    """(word, key, place): up to per_word sentences of each word; words in the order of rank, then word, share the sentences.

    A word passes its candidates in the order of total, burden, beyond and key: first those that share fewer than two
    word pairs with each pick so far, then any. A sentence that `reuse` words in front have taken is closed to it.

    Equal to going through the words one by one, in rounds over all: each word picks as if the picks of the last round
    stood; a sentence is closed to the words behind the first `reuse` that picked it. In round n the first n words in
    order have what they would get one by one, and what doesn't change from one round to the next is that result. Only
    words with another set of closed sentences pick again. A sentence is picked by as many words as it has, 16 at most.

    The first `head` candidates of a word are a list. A word that they don't fill with sentences unlike each other goes
    on among the rest of its candidates, which are rows: all are looked at, no group grows with the table.
    """
    head = max(head, per_word)
    order = F.struct(*_ORDER)
    near = F.row_number().over(W.partitionBy("word").orderBy(*_ORDER))
    lists = candidates.withColumn("n", near).where(F.col("n") <= head)
    lists = lists.groupBy("word", "rank").agg(F.array_sort(F.collect_list(order)).alias("all"))
    lists = cut(lists, "candidates", "zstd")
    held = []  # (words, rest) of words whose head did not do in some round

    def pick(words: DataFrame, full: DataFrame | None) -> DataFrame:
        """(word, rank, closed, picks) of (word, rank, all, closed)."""
        free = F.when(F.size("closed") == 0, F.col("all")).otherwise(F.filter("all", lambda c: ~F.array_contains(F.col("closed"), c["key"])))
        opened = words.withColumn("open", F.transform(free, lambda c: F.struct(c["key"].alias("key"), _pairs(c["key"]).alias("pairs"))))
        first = opened.select("word", "rank", "closed", F.col("open.key").alias("open"), _unlike(per_word).alias("first"), (F.size("all") >= head).alias("more"))
        first = cut(first.withColumn("more", F.col("more") & (F.size("first") < per_word)), "first")
        done = first.where("NOT more").select("word", "rank", "closed", _filled(F.col("first.key"), F.col("open"), per_word).alias("picks"))
        short = first.where("more")
        if short.isEmpty():
            return cut(done, "picks")
        new = short.select("word")
        for known, _ in held:
            new = new.join(known, "word", "left_anti")
        new = cut(new, "short")
        if not new.isEmpty():
            last = lists.join(new, "word").select("word", F.element_at("all", -1).alias("last"))
            held.append((new, cut(candidates.join(last, "word").where(order > F.col("last")).drop("last"), "rest", "zstd")))
        rest = _from_rest(short.drop("more"), reduce(DataFrame.unionByName, [rows for _, rows in held]), full, per_word)
        return cut(done.unionByName(rest), "picks")

    pool = lists.select("word", "rank", F.explode("all.key").alias("key"))
    none = F.expr("CAST(array() AS array<string>)")
    picks = pick(lists.withColumn("closed", none), None)
    before = None
    for _ in range(rounds):
        each = picks.select("word", "rank", F.explode("picks").alias("key"))
        turn = F.row_number().over(W.partitionBy("key").orderBy("rank", "word"))
        full = cut(each.withColumn("turn", turn).where(F.col("turn") == reuse).select("key", F.struct("rank", "word").alias("last")), "full")
        # sentences whose last taker is another one than a round ago, and the words that have them among their candidates
        moved = full
        if before is not None:
            moved = full.join(before.select("key", F.col("last").alias("old")), "key", "full").where("NOT last <=> old").select("key", "last")
        met = pool.join(moved, "key").withColumn("shut", F.coalesce(F.struct("rank", "word") > F.col("last"), F.lit(False)))
        met = met.groupBy("word").agg(*[F.collect_list(F.when(F.col("shut") == shut, F.col("key"))).alias(name) for name, shut in (("shut", True), ("free", False))])
        now = F.array_sort(F.array_union(F.array_except("closed", "free"), "shut"))
        changed = picks.select("word", "closed").join(met, "word").withColumn("now", now).where("now <> closed").select("word", F.col("now").alias("closed"))
        if held:
            touched = reduce(DataFrame.unionByName, [rows.select("word", "key") for _, rows in held]).join(moved, "key").select("word").distinct()
            changed = cut(changed, "changed-heads")
            changed = changed.unionByName(picks.select("word", "closed").join(touched, "word").join(changed, "word", "left_anti"))
        changed = cut(changed, "changed")
        if changed.isEmpty():
            return picks.select("word", F.posexplode("picks").alias("place", "key")).withColumn("place", F.col("place") + 1)
        again = pick(lists.join(changed, "word"), full)
        picks = cut(picks.join(again.select("word"), "word", "left_anti").unionByName(again), "picks")
        before = full
    raise RuntimeError(f"choices did not settle in {rounds} rounds")
