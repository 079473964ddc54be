"""Readers: songs, line pairs, dictionaries, frequency lists, imports, timed lyrics, page payloads (SRC01-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SONG = "array<struct<id:string,title:string,lyrics:string>>"
WIKTIONARY = (
    "word string, pos string, lang_code string, "
    "senses array<struct<glosses:array<string>,tags:array<string>,form_of:array<struct<word:string>>>>, "
    "etymology_templates array<struct<name:string,args:map<string,string>>>"
)
SKIP_TAGS = ("obsolete", "archaic", "misspelling")


def songs(spark: SparkSession, glob: str) -> DataFrame:
    """SRC01: (id, title, lyrics, batch, song_order) of files that each hold a JSON array of songs."""
    raw = spark.read.option("wholetext", True).text(glob).select("value", F.input_file_name().alias("batch"))
    return raw.select("batch", F.posexplode(F.from_json("value", SONG)).alias("song_order", "s")).select("s.id", "s.title", "s.lyrics", "batch", "song_order")


def pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC02: (english, target) of a tab-separated file; rows with fewer fields or an empty side are left out."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 2")
    return rows.select(F.trim(F.col("f")[0]).alias("english"), F.trim(F.col("f")[1]).alias("target")).where("english <> '' and target <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines of text files in order, numbered from 0.

    A window numbers the lines of each split; sums of the splits' counts, a row for each split, give where it begins.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    own = F.row_number().over(W.partitionBy("f", "b").orderBy("i")) - 1
    before = F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1))
    splits = raw.groupBy("f", "b").agg(F.count("*").alias("n")).select("f", "b", F.coalesce(before, F.lit(0)).alias("ahead"))
    return raw.withColumn("own", own).join(splits, ["f", "b"]).select((F.col("ahead") + F.col("own")).alias("line_no"), "value")


def parallel_lines(spark: SparkSession, target: str, english: str, most: int | None = None) -> DataFrame:
    """SRC03, SRC04: (line_no, target, english) of two line-aligned files; with `most` every (total / most)-th line."""
    a = numbered_lines(spark, target).withColumnRenamed("value", "target")
    both = a.join(numbered_lines(spark, english).withColumnRenamed("value", "english"), "line_no")
    if most is None:
        return both
    stride = both.agg(F.greatest(F.lit(1), F.floor(F.count("*") / F.lit(most))).alias("stride"))
    return both.join(F.broadcast(stride), F.lit(True)).where("line_no % stride = 0").drop("stride")


def wiktionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC05: (entries, redirects) of JSON lines: first glosses of real senses; else the bases a form refers to."""
    rows = spark.read.schema(WIKTIONARY).json(path).select("word", "pos", F.posexplode_outer("senses").alias("n", "s"))
    barred = F.arrays_overlap(F.coalesce("s.tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in SKIP_TAGS]))
    rows = rows.select("word", "pos", "n", F.col("s.glosses")[0].alias("gloss"), F.col("s.form_of.word").alias("bases"), F.coalesce(barred, F.lit(False)).alias("barred"))
    real = rows.where("gloss is not null and not barred and (bases is null or size(bases) = 0)")
    entries = real.groupBy("word", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "gloss"))).alias("s")).select("word", "pos", F.col("s.gloss").alias("glosses"))
    forms = rows.where("size(bases) > 0").join(real.select("word", "pos"), ["word", "pos"], "left_anti")
    redirects = forms.select("word", "n", F.posexplode("bases").alias("k", "base")).groupBy("word", "base").agg(F.min(F.struct("n", "k")).alias("place"))
    return entries, redirects.select("word", "base", F.row_number().over(W.partitionBy("word").orderBy("place")).alias("place"))


def name_only_words(spark: SparkSession, path: str) -> DataFrame:
    """SRC06: words all of whose entries are names."""
    rows = spark.read.schema(WIKTIONARY).json(path)
    return rows.groupBy("word").agg(F.bool_and(F.col("pos") == "name").alias("only")).where("only").select("word")


def morphology_layer(spark: SparkSession, path: str) -> DataFrame:
    """SRC07: (word, lemma, mood, tense, person) of verbs' form-of senses, each once; person is empty without one."""
    rows = spark.read.schema(WIKTIONARY).json(path).where("pos = 'verb'").select("word", F.explode("senses").alias("s"))
    rows = rows.select("word", F.explode("s.form_of").alias("f"), "s.tags").select("word", F.col("f.word").alias("lemma"), "tags")
    first = lambda *names: F.array_join(F.array_intersect("tags", F.array(*[F.lit(n) for n in names])), " ")
    return rows.select(
        "word", "lemma", first("indicative", "subjunctive", "imperative").alias("mood"), first("present", "preterite", "imperfect", "future", "conditional").alias("tense"),
        F.coalesce(first("first-person", "second-person", "third-person", "singular", "plural"), F.lit("")).alias("person"),
    ).distinct()


def loanwords(spark: SparkSession, path: str, source: str) -> DataFrame:
    """SRC08: (word, pos) of words each of whose entries has a borrowing template from the source language."""
    rows = spark.read.schema(WIKTIONARY).json(path)
    borrowed = F.coalesce(F.exists("etymology_templates", lambda t: t["name"].isin("bor", "borrowed", "bor+") & (t["args"]["2"] == source)), F.lit(False))
    each = rows.groupBy("word").agg(F.bool_and(borrowed).alias("all"), F.array_join(F.sort_array(F.collect_set("pos")), ",").alias("pos"))
    return each.where("all").select("word", "pos")


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC09: (word, ppm, lemmas) of a frequency list with a header: the highest ppm of a surface, whole, and its lemmas."""
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy("word").agg(F.max(F.col("ppm").cast("double")).cast("int").alias("ppm"), F.array_join(F.sort_array(F.collect_set("lemma")), ",").alias("lemmas"))


def lexicon_ranks(spark: SparkSession, path: str, top: int) -> DataFrame:
    """SRC10: (key, rank): lowest rank of surface or lemma among the `top` forms of most summed frequency."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path).withColumn("freq", F.col("freq").cast("double"))
    pairs = rows.groupBy("ortho", "lemma").agg(F.sum("freq").alias("freq"))
    sums = pairs.groupBy("ortho").agg(F.sum("freq").alias("freq"), F.max(F.struct("freq", "lemma")).getField("lemma").alias("lemma"))
    best = sums.orderBy(F.desc("freq"), "ortho").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("freq"), "ortho")))
    keys = ranked.select(F.col("ortho").alias("key"), "rank").union(ranked.select("lemma", "rank"))
    return keys.groupBy("key").agg(F.min("rank").alias("rank"))


def glosses_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: (infinitive, gloss), the least gloss of each."""
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy("infinitive").agg(F.min("infinitive_english").alias("gloss"))


def title_basics(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """SRC12: rows of a tab-separated file, with \\N as null, whose tconst is wanted."""
    rows = spark.read.option("header", True).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)
    return rows.join(wanted.select("tconst"), "tconst", "left_semi")


ALIASES = {"surface": ("word", "surface", "entry"), "lemma": ("lemma", "base"), "last_correct": ("last_correct", "lastcorrect"), "last_wrong": ("last_wrong", "last_incorrect", "lastwrong")}


def vocabulary_import(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (line, surface, lemma, last_correct, last_wrong) of plain text, CSV or TSV; the header's names may vary.

    The separator is read off the first line (one row reaches the driver); without a known header each line is a surface.
    """
    lines = numbered_lines(spark, path).select("line_no", F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "").alias("value"))
    head = (lines.where("line_no = 0").select("value").first() or [""])[0]
    sep = "\t" if "\t" in head else ","
    names = [c.strip().strip('"').lower().replace(" ", "_") for c in head.split(sep)]
    at = {k: next((names.index(a) for a in v if a in names), None) for k, v in ALIASES.items()}
    if at["surface"] is None:
        none = F.lit(None).cast("string")
        return lines.where("trim(value) <> ''").select((F.col("line_no") + 1).alias("line"), F.trim("value").alias("surface"), none.alias("lemma"), none.alias("last_correct"), none.alias("last_wrong"))
    kind = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = lines.where("line_no > 0 and trim(value) <> ''").select("line_no", F.from_csv("value", kind, {"sep": sep, "quote": '"', "escape": '"'}).alias("r"))
    pick = lambda k: (F.lit(None) if at[k] is None else F.nullif(F.trim(f"r.c{at[k]}"), F.lit(""))).cast("string").alias(k)
    return fields.select((F.col("line_no") + 1).alias("line"), *[pick(k) for k in ALIASES])


def jsonl(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """SRC14: rows of JSON lines; a malformed line, or two different rows of one id, is an error, a repeat is not."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).distinct()
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"different rows have the id {twice[0][0]}")
    return rows


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: one row for each word, method, sense and example of {word: {method: [{sense, examples}]}}."""
    shape = "map<string,map<string,array<struct<sense:string,examples:array<int>,confidence:double>>>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", shape)).alias("word", "m"))
    rows = raw.select("word", F.explode("m").alias("method", "items")).select("word", "method", F.posexplode("items").alias("ord", "i"))
    return rows.select("word", "method", "ord", "i.sense", "i.confidence", F.explode_outer("i.examples").alias("example_idx"))


def lrc(rows: DataFrame, key: str, synced: str, duration: str) -> DataFrame:
    """SRC16: (key, ms, end_ms, text) of timed lyrics; a line ends at the next larger time, the last at the duration.

    Blank lines only bound others.
    """
    lines = rows.select(key, duration, F.posexplode(F.split(synced, "\n")).alias("i", "line"))
    stamp = F.regexp_extract_all("line", F.lit(r"\[(\d+):(\d+)(?:\.(\d{1,3}))?\]"), F.lit(0))
    part = lambda n: F.regexp_extract("stamp", r"\[(\d+):(\d+)(?:\.(\d{1,3}))?\]", n)
    timed = lines.select(key, duration, "i", F.explode(stamp).alias("stamp"), F.trim(F.regexp_replace("line", r"\[[^\]]*\]", "")).alias("text"))
    ms = part(1).cast("int") * 60000 + part(2).cast("int") * 1000 + F.coalesce(F.nullif(F.rpad(part(3), 3, "0"), F.lit("000")), F.lit("0")).cast("int")
    timed = timed.withColumn("ms", ms)
    following = F.min("ms").over(W.partitionBy(key).orderBy("ms").rangeBetween(1, W.unboundedFollowing))
    return timed.withColumn("end_ms", F.coalesce(following, F.col(duration))).where("text <> ''").select(key, "ms", "end_ms", "text")


def component(html: Column, name: str, schema: str) -> Column:
    """SRC17: the first `NAME = {...};` of a page as a struct; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(html, rf"(?s){name}\s*=\s*(\{{.*?\}});", 1), F.lit("")), schema)


THESAURUS = "struct<headword:string,links:array<struct<word:string,relationship:int>>,senses:array<struct<pos:string,translations:array<string>>>>"


def thesaurus(pages: DataFrame, key: str, html: str, name: str = "window.DATA") -> DataFrame:
    """SRC18: (key, headword, pos, translation) of pages' payloads; none where headword, links or senses are empty."""
    rows = pages.select(key, component(F.col(html), name, THESAURUS).alias("p")).where("p.headword <> '' and size(p.links) > 0 and size(p.senses) > 0")
    rows = rows.select(key, "p.headword", F.explode("p.senses").alias("s"))
    return rows.select(key, "headword", "s.pos", F.explode_outer("s.translations").alias("translation"))
