"""Words with attached pronouns taken apart: gerund, infinitive, imperative; and three tiers of what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attached pronouns, short infinitives, and tags of ordinary words.
PRONOUNS = ("nos", "les", "los", "las", "me", "te", "se", "lo", "la", "le")
SHORT_INFINITIVES = ("ir", "dar", "ver", "ser", "oir")
ORDINARY = ("noun", "adj", "adv", "name", "num", "pron")
INFINITIVE, STEM = 4, 3
ACUTE, PLAIN = "áéíóúý", "aeiouy"


def without_acute(word: Column) -> Column:
    """Acute accents off; ñ and ü stay."""
    return F.translate(word, ACUTE, PLAIN)


def _stripped(words: DataFrame, left_over: int) -> DataFrame:
    """(word, r1, c1, r2, c2): what is left of a word without one and two pronouns, and these; null where there is none.

    `left_over` letters or more stay each time. No pronoun ends with another one, so that their order doesn't matter.
    """
    ended = f"^(.{{{left_over},}})({'|'.join(PRONOUNS)})$"
    part = lambda word, i: F.nullif(F.regexp_extract(word, ended, i), F.lit(""))
    rows = words.select("word", part("word", 1).alias("r1"), part("word", 2).alias("c1"))
    return rows.select("*", part("r1", 1).alias("r2"), part("r1", 2).alias("c2"))


def decompose(words: DataFrame, known: DataFrame, verbs: DataFrame, imperatives: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, base, clitics, host, kind) of words made of a verb and one or two attached pronouns.

    known: word. verbs: word, infinitives with evidence of a verb. imperatives: word, base, person, affirmative imperative
    forms. forms: word, tags (array), conjugated (boolean: itself a form of a verb). In order: a gerund without its
    pronouns (five letters or more are left each time), whose infinitive is known; an infinitive of four letters, or a
    short one, known and a verb, with one pronoun, else two; an affirmative imperative with one, else two, the second
    person's reading first. There the word must not be a form of a verb itself; with a written accent no tag may be that
    of an ordinary word, without one its only tag must be "verb". Words are in lower case; others are left out.
    """
    clitics = F.when(F.col("c2").isNull(), F.array("c1")).otherwise(F.array("c2", "c1"))
    gerund = _stripped(words, 5).where("c1 is not null").withColumn("host", F.coalesce("r2", "r1")).withColumn("clitics", clitics)
    clean = without_acute(F.col("host"))
    base = F.when(clean.endswith("ando"), F.regexp_replace(clean, "ando$", "ar")).when(clean.endswith("iendo"), F.regexp_replace(clean, "iendo$", "ir"))
    base = base.when(clean.endswith("endo"), F.regexp_replace(clean, "endo$", "er"))
    row = ["word", "base", "clitics", "host"]
    first = gerund.withColumn("base", base).join(known.select(F.col("word").alias("base")).distinct(), "base", "left_semi").select(*row, F.lit(0).alias("turn"))
    steps = F.array(
        F.struct(F.lit(1).alias("turn"), F.col("r1").alias("host"), F.array("c1").alias("clitics")), F.struct(F.lit(2).alias("turn"), F.col("r2").alias("host"), F.array("c2", "c1").alias("clitics"))
    )
    each = _stripped(words, STEM).where("c1 is not null").select("word", F.explode(steps).alias("x")).select("word", "x.*").where("host is not null")
    each = each.withColumn("base", without_acute(F.col("host")))
    fits = F.col("base").rlike("[aei]r$") & ((F.length("base") >= INFINITIVE) | F.col("base").isin(*SHORT_INFINITIVES))
    evidence = verbs.select(F.col("word").alias("base")).distinct().join(known.select(F.col("word").alias("base")), "base", "left_semi")
    second = each.where(fits).join(evidence, "base", "left_semi").select(*row, "turn")
    lemma = imperatives.groupBy("word").agg(F.min_by("base", F.struct((F.col("person") != "2s").alias("other"), "base")).alias("lemma"))
    third = each.withColumnRenamed("base", "form").join(lemma.withColumnRenamed("word", "form"), "form")
    # the first host that is an imperative decides, whether it may be one or not
    third = third.groupBy("word").agg(F.min_by(F.struct(F.col("lemma").alias("base"), "clitics", "host"), "turn").alias("x")).select("word", "x.*")
    third = third.join(forms.select("word", "tags", "conjugated"), "word", "left")
    tags, accent = F.coalesce("tags", F.array().cast("array<string>")), without_acute(F.col("host")) != F.col("host")
    may = F.when(accent, ~F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ORDINARY]))).otherwise(F.array_distinct(tags) == F.array(F.lit("verb")))
    third = third.where(~F.coalesce("conjugated", F.lit(False)) & may).select(*row, F.lit(3).alias("turn"))
    every = first.unionByName(second).unionByName(third).groupBy("word").agg(F.min_by(F.struct("base", "clitics", "host", "turn"), "turn").alias("x"))
    kind = F.when(F.col("turn") == 0, "gerund").when(F.col("turn") < 3, "infinitive").otherwise("imperative")
    return every.select("word", "x.*").withColumn("kind", kind).drop("turn")


def tiers(words: DataFrame, listed: DataFrame, decomposed: DataFrame, parents: DataFrame) -> DataFrame:
    """(word, target, tier) of words with attached pronouns: merge into a word that is there, orphan, or keep.

    words: word, all that are there. listed: word, base, clitics, as a dictionary has them; it comes before decomposed
    ones. parents: word, the reflexive verbs that own a card. A word with a single reflexive pronoun whose base has a
    parent in -se keeps its own card; else it merges into itself without its pronouns and accents, if that is a word,
    else into its base, which is an orphan if it isn't there.
    """
    own = listed.select("word", "base", "clitics").join(words.select("word"), "word", "left_semi")
    more = decomposed.select("word", "base", "clitics").join(own.select("word"), "word", "left_anti").join(words.select("word"), "word", "left_semi")
    rows = own.unionByName(more)
    reflexive = (F.size("clitics") == 1) & F.get("clitics", F.lit(0)).isin("me", "te", "se", "nos")
    rows = rows.withColumn("parent", F.when(reflexive, F.concat("base", F.lit("se"))))
    rows = rows.join(parents.select(F.col("word").alias("parent"), F.lit(True).alias("owned")).distinct(), "parent", "left")
    bare = without_acute(F.expr("left(word, length(word) - length(array_join(clitics, '')))"))
    rows = rows.withColumn("bare", bare)
    there = words.select("word").distinct()
    rows = rows.join(there.select(F.col("word").alias("bare"), F.lit(True).alias("bare_there")), "bare", "left")
    rows = rows.join(there.select(F.col("word").alias("base"), F.lit(True).alias("base_there")), "base", "left")
    tier = F.when(F.col("owned"), "keep").when(F.col("bare_there") | F.col("base_there"), "merge").otherwise("orphan")
    target = F.when(F.col("owned"), F.col("parent")).when(F.col("bare_there"), F.col("bare")).otherwise(F.col("base"))
    return rows.select("word", target.alias("target"), tier.alias("tier"))
