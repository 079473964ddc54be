"""Queries on words with attached pronouns, made of Spanish words as stems (MOR03, MOR04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import enclitics as E
from lexspark.session import cut, table

#: What is built of a stem: surfaces with pronouns, by the stem's number modulo 8.
BUILT = ("ándote", "armelo", "arte", "ándoselo", "ála", "ámelo", "ale", "arnos")


def _number(word):
    """A number that follows from a word."""
    return F.conv(F.substring(F.sha1(F.col(word).cast("binary")), 1, 7), 16, 10).cast("long")


def _stems(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("stem")).distinct().where("length(stem) >= 3")
    return cut(words.withColumn("k", _number("stem")), "stems")


def _parts(spark, sf_dir):
    """All words, and those of them taken apart; every second stem is a verb in -ar, every third one's imperative is known."""
    stems = _stems(spark, sf_dir)
    built = stems.select(F.concat("stem", F.get(F.array(*[F.lit(b) for b in BUILT]), (F.col("k") % 8).cast("int"))).alias("word"), "k")
    verbs = stems.where("k % 2 = 0").select(F.concat("stem", F.lit("ar")).alias("word"))
    imperatives = stems.where("k % 3 = 0").select(F.concat("stem", F.lit("a")).alias("word"), F.concat("stem", F.lit("ar")).alias("base"), F.lit("2s").alias("person"))
    tags = F.when(F.col("k") % 5 == 0, F.array(F.lit("noun"), F.lit("verb"))).when(F.col("k") % 5 < 4, F.array(F.lit("verb")))
    forms = built.select("word", tags.alias("tags"), (F.col("k") % 11 == 0).alias("conjugated"))
    words = built.select("word").union(stems.select("stem")).union(verbs.where(_number("word") % 4 > 0)).distinct()
    known = words.union(verbs)
    return cut(words, "words"), cut(E.decompose(words, known, verbs, imperatives, forms), "parts"), stems


def enclitic_parts(spark, sf_dir):
    """MOR03: base, pronouns and kind of each word that is a verb with pronouns."""
    made = _parts(spark, sf_dir)[1]
    return made.select("word", "base", F.array_join("clitics", "+").alias("clitics"), "kind")


def enclitic_tiers(spark, sf_dir):
    """MOR04: what becomes of words with attached pronouns; every seventh stem's verb owns a reflexive card."""
    words, made, stems = _parts(spark, sf_dir)
    parents = stems.where("k % 7 = 0").select(F.concat("stem", F.lit("arse")).alias("word"))
    listed = made.where("kind = 'gerund'").select("word", F.concat("base", F.lit("se")).alias("base"), "clitics").where(_number("word") % 9 == 0)
    return E.tiers(words, listed, made, parents)


QUERIES = {f.__name__: f for f in (enclitic_parts, enclitic_tiers)}

TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"


def _off(word: str, left: int) -> str:
    order = ("nos", "les", "los", "las", "me", "te", "se", "lo", "la", "le")
    return "CASE " + " ".join(f"WHEN ends_with({word}, '{p}') AND length({word}) >= {left + len(p)} THEN '{p}'" for p in order) + " END"


def _strip(name: str, left: int) -> str:
    return f"""{name}1 AS (SELECT word, {_off('word', left)} AS c1 FROM w), {name}2 AS (SELECT word, c1, left(word, length(word) - length(c1)) AS r1 FROM {name}1 WHERE c1 IS NOT NULL),
 {name}3 AS (SELECT *, {_off('r1', left)} AS c2 FROM {name}2), {name} AS (SELECT *, left(r1, length(r1) - length(c2)) AS r2 FROM {name}3)"""


NUMBER = "CAST('0x' || left(sha1(%s), 7) AS BIGINT)"
PLAIN = "translate(%s, 'áéíóúý', 'aeiouy')"
PARTS = f"""st AS MATERIALIZED (SELECT word AS stem, {NUMBER % 'word'} AS k FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents WHERE lang = 'es') WHERE length(word) >= 3),
 bu AS MATERIALIZED (SELECT stem || ['ándote', 'armelo', 'arte', 'ándoselo', 'ála', 'ámelo', 'ale', 'arnos'][k % 8 + 1] AS word, k FROM st), ve AS MATERIALIZED (SELECT stem || 'ar' AS word FROM st WHERE k % 2 = 0), im AS (SELECT stem || 'a' AS form, stem || 'ar' AS base FROM st WHERE k % 3 = 0),
 w AS MATERIALIZED (SELECT word FROM bu UNION SELECT stem FROM st UNION SELECT word FROM ve WHERE {NUMBER % 'word'} % 4 > 0), kn AS MATERIALIZED (SELECT word FROM w UNION SELECT word FROM ve),
 {_strip('g', 5)}, {_strip('s', 3)}, gh AS (SELECT word, coalesce(r2, r1) AS host, CASE WHEN c2 IS NULL THEN c1 ELSE c2 || '+' || c1 END AS clitics FROM g), gp AS (SELECT *, {PLAIN % 'host'} AS h FROM gh),
 gb AS (SELECT word, clitics, host, CASE WHEN ends_with(h, 'ando') THEN left(h, length(h) - 4) || 'ar' WHEN ends_with(h, 'iendo') THEN left(h, length(h) - 5) || 'ir' WHEN ends_with(h, 'endo') THEN left(h, length(h) - 4) || 'er' END AS base FROM gp),
 sh AS (SELECT word, 1 AS turn, r1 AS host, c1 AS clitics FROM s UNION ALL SELECT word, 2, r2, c2 || '+' || c1 FROM s WHERE r2 IS NOT NULL), sb AS (SELECT *, {PLAIN % 'host'} AS base FROM sh),
 i3 AS (SELECT sb.word, turn, host, clitics, im.base FROM sb JOIN im ON im.form = sb.base QUALIFY row_number() OVER (PARTITION BY sb.word ORDER BY turn) = 1),
 ok AS (SELECT i3.* FROM i3 LEFT JOIN bu ON bu.word = i3.word WHERE NOT coalesce(bu.k % 11 = 0, false) AND CASE WHEN {PLAIN % 'host'} <> host THEN NOT coalesce(bu.k % 5 = 0, false) ELSE coalesce(bu.k % 5 BETWEEN 1 AND 3, false) END),
 ev AS (SELECT word, base, clitics, 0 AS turn, 'gerund' AS kind FROM gb WHERE base IN (SELECT word FROM kn) UNION ALL
  SELECT word, base, clitics, turn, 'infinitive' FROM sb WHERE regexp_matches(base, '[aei]r$') AND (length(base) >= 4 OR base IN ('ir', 'dar', 'ver', 'ser', 'oir')) AND base IN (SELECT word FROM ve) UNION ALL SELECT word, base, clitics, 3, 'imperative' FROM ok),
 parts AS MATERIALIZED (SELECT word, base, clitics, kind FROM ev QUALIFY row_number() OVER (PARTITION BY word ORDER BY turn) = 1)"""
ORACLES = {
    "enclitic_parts": f"WITH {PARTS} SELECT word, base, clitics, kind FROM parts",
    "enclitic_tiers": f"""WITH {PARTS}, li AS (SELECT word, base || 'se' AS base, clitics FROM parts WHERE kind = 'gerund' AND {NUMBER % 'word'} % 9 = 0), al AS (SELECT * FROM li UNION ALL SELECT word, base, clitics FROM parts WHERE word NOT IN (SELECT word FROM li)),
 pa AS (SELECT stem || 'arse' AS parent FROM st WHERE k % 7 = 0), x AS (SELECT *, clitics IN ('me', 'te', 'se', 'nos') AND base || 'se' IN (SELECT parent FROM pa) AS owned, {PLAIN % "left(word, length(word) - length(replace(clitics, '+', '')))"} AS bare FROM al)
SELECT word, CASE WHEN owned THEN base || 'se' WHEN bare IN (SELECT word FROM w) THEN bare ELSE base END AS target, CASE WHEN owned THEN 'keep' WHEN bare IN (SELECT word FROM w) OR base IN (SELECT word FROM w) THEN 'merge' ELSE 'orphan' END AS tier FROM x""",
}
