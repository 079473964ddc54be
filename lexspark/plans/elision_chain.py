"""The chain of rules that puts elided words back, on Spanish words and what a singer leaves of them (MOR01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import elisions as E
from lexspark.session import cut, table

TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"
#: What is sung of a word: without the d of -ado in four spellings, its last s, its third letter; and a mark of the mapping.
SUNG = (
    ("^(.+)ado$", "$1a'o"), ("^(.+)ado$", "$1a'u"), ("^(.+)ado$", "$1ao"), ("^(.+)ado$", "$1ao'"), ("^(..+)s$", "$1'"),
    ("^(..)[^aeiouáéíóúü'](.+)$", "$1'$2"), ("^(..)$", "$1’"), ("^(.+)$", "$1"),
)


def _uses(spark, sf_dir):
    """(word, song, n): Spanish words as sung, by document."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    words = docs.select(F.col("doc_id").alias("song"), F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word", "song").agg(F.count("*").alias("n"))
    forms = F.array_distinct(F.array(*[F.when(F.col("word").rlike(a), F.regexp_replace("word", a, b)) for a, b in SUNG]))
    sung = words.select("song", "n", F.explode(F.array_compact(forms)).alias("word"))
    return words, sung.groupBy("word", "song").agg(F.sum("n").alias("n"))


def _restored(spark, sf_dir):
    words, sung = _uses(spark, sf_dir)
    known = words.groupBy("word").agg(F.sum("n").alias("uses")).withColumn("registered", F.length("word") == 3)
    known = cut(known, "known")
    mapping = known.where("length(word) = 2").select(F.concat("word", F.lit("’")).alias("word"), F.col("word").alias("target"))
    sung = cut(sung, "sung")
    return sung, E.restored(sung.select("word").distinct(), known, mapping)


def elision_chain(spark, sf_dir):
    """MOR01: the word that each sung form stands for, and the rule that told."""
    return _restored(spark, sf_dir)[1]


def elision_counts(spark, sf_dir):
    """MOR01: uses, songs and variants of words after sung forms are counted for the words they stand for."""
    sung, links = _restored(spark, sf_dir)
    return E.merged_counts(sung, cut(links, "links"))


QUERIES = {f.__name__: f for f in (elision_chain, elision_counts)}

# the rules once more, written out for SQL: tier, place, kind, ending, restored, ending of the base that must be known
RULES = """r(tier, place, kind, ending, full_, base) AS (VALUES (1, 0, 'd_elision', 'a''os', 'ados', NULL), (1, 1, 'd_elision', 'a''as', 'adas', NULL), (1, 2, 'd_elision', 'í''os', 'idos', NULL),
 (1, 3, 'd_elision', 'í''as', 'idas', NULL), (1, 4, 'd_elision', 'a''o', 'ado', NULL), (1, 5, 'd_elision', 'a''a', 'ada', NULL), (1, 6, 'd_elision', 'í''o', 'ido', NULL), (1, 7, 'd_elision', 'í''a', 'ida', NULL),
 (2, 10, 'd_elision_diminutive', 'a[''’][íi]tos', 'aditos', 'ado'), (2, 11, 'd_elision_diminutive', 'a[''’][íi]tas', 'aditas', 'ado'), (2, 12, 'd_elision_diminutive', 'a[''’][íi]to', 'adito', 'ado'),
 (2, 13, 'd_elision_diminutive', 'a[''’][íi]ta', 'adita', 'ado'), (2, 14, 'd_elision_diminutive', 'u[''’][íi]tos', 'uditos', 'udo'), (2, 15, 'd_elision_diminutive', 'u[''’][íi]tas', 'uditas', 'udo'),
 (2, 16, 'd_elision_diminutive', 'u[''’][íi]to', 'udito', 'udo'), (2, 17, 'd_elision_diminutive', 'u[''’][íi]ta', 'udita', 'udo'), (2, 18, 'd_elision_diminutive', '[íi][''’][íi]tos', 'iditos', 'ido'),
 (2, 19, 'd_elision_diminutive', '[íi][''’][íi]tas', 'iditas', 'ido'), (2, 20, 'd_elision_diminutive', '[íi][''’][íi]to', 'idito', 'ido'), (2, 21, 'd_elision_diminutive', '[íi][''’][íi]ta', 'idita', 'ido'),
 (2, 22, 'd_elision_u_final', 'a[''’]us', 'ados', NULL), (2, 23, 'd_elision_u_final', 'a[''’]u', 'ado', NULL), (2, 24, 'd_elision_unaccented', 'i[''’]os', 'idos', NULL), (2, 25, 'd_elision_unaccented', 'i[''’]as', 'idas', NULL),
 (2, 26, 'd_elision_unaccented', 'i[''’]o', 'ido', NULL), (2, 27, 'd_elision_unaccented', 'i[''’]a', 'ida', NULL), (2, 28, 'd_elision_ustem', 'u[''’]os', 'udos', NULL), (2, 29, 'd_elision_ustem', 'u[''’]as', 'udas', NULL),
 (2, 30, 'd_elision_ustem', 'u[''’]o', 'udo', NULL), (2, 31, 'd_elision_ustem', 'u[''’]a', 'uda', NULL), (6, 40, 'bare_d_elision', 'aítas', 'aditas', 'ado'), (6, 41, 'bare_d_elision', 'aítos', 'aditos', 'ado'),
 (6, 42, 'bare_d_elision', 'aíta', 'adita', 'ado'), (6, 43, 'bare_d_elision', 'aíto', 'adito', 'ado'), (6, 50, 'bare_d_elision', 'íos', 'idos', NULL), (6, 51, 'bare_d_elision', 'ías', 'idas', NULL),
 (6, 52, 'bare_d_elision', 'aos', 'ados', NULL), (6, 53, 'bare_d_elision', 'ás', 'adas', NULL), (6, 54, 'bare_d_elision', 'ío', 'ido', NULL), (6, 55, 'bare_d_elision', 'ía', 'ida', NULL), (6, 56, 'bare_d_elision', 'ao', 'ado', NULL))"""
FORMS = ", ".join(f"CASE WHEN regexp_matches(word, '{a}') THEN regexp_replace(word, '{a}', '{b}') END" for a, b in ((a.replace("'", "''"), b.replace("'", "''").replace("$", "\\")) for a, b in SUNG))
CHAIN = f"""{RULES}, u AS (SELECT doc_id AS song, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents WHERE lang = 'es') GROUP BY ALL),
 k AS (SELECT word, sum(n) AS uses, length(word) = 3 AS registered FROM u GROUP BY word),
 sung AS (SELECT word, song, CAST(sum(n) AS BIGINT) AS n FROM (SELECT song, n, unnest(list_distinct([{FORMS}])) AS word FROM u) WHERE word IS NOT NULL GROUP BY ALL), w AS (SELECT DISTINCT word FROM sung),
 t AS (SELECT word, word AS part, false AS cut FROM w UNION ALL SELECT word, left(word, length(word) - 1), true FROM w WHERE ends_with(word, '''')),
 e AS (SELECT word, part, CASE WHEN cut THEN 3 ELSE tier END AS tier, place, CASE WHEN cut THEN 'double_elision' ELSE kind END AS kind, regexp_replace(part, ending || '$', full_) AS full_, tier = 1 AS free, tier = 6 AS bare,
  CASE WHEN base IS NOT NULL THEN regexp_replace(part, ending || '$', base) END AS base FROM t JOIN r ON regexp_matches(part, '^.+' || ending || '$')),
 h AS (SELECT word, tier, place, kind, full_ FROM e WHERE free OR ((NOT bare OR part NOT IN (SELECT word FROM k)) AND ((full_ IN (SELECT word FROM k) AND NOT (bare AND base IS NOT NULL)) OR base IN (SELECT word FROM k)))),
 one AS (SELECT word, tier, kind, full_ FROM h QUALIFY row_number() OVER (PARTITION BY word, tier ORDER BY place) = 1),
 f AS (SELECT x.word, k.word AS full_, uses, registered FROM (SELECT word, left(word, length(word) - 1) || unnest(['s', 'd', 'z', 'r', 'l', 'n']) AS c FROM w WHERE ends_with(word, '''') AND length(word) >= 3
   AND left(word, length(word) - 1) NOT IN (SELECT word FROM k WHERE registered)) x JOIN k ON k.word = c),
 g AS (SELECT word, list(full_ ORDER BY uses DESC, full_ DESC) AS fs, list(uses ORDER BY uses DESC, full_ DESC) AS us, list(full_) FILTER (registered) AS own FROM f GROUP BY word),
 last_ AS (SELECT word, 4 AS tier, 'trailing_apos' AS kind, CASE WHEN len(own) = 1 THEN own[1] WHEN len(fs) = 1 AND us[1] > 0 THEN fs[1] WHEN len(fs) > 1 AND us[1] >= greatest(4 * us[2], 20) THEN fs[1] END AS full_ FROM g),
 i AS (SELECT word, replace(replace(word, '’', ''''), '''', '') AS b, strpos(replace(word, '’', ''''), '''') AS spot FROM w WHERE length(word) >= 3 AND length(regexp_replace(word, '[^''’]', '', 'g')) = 1),
 j AS (SELECT DISTINCT word, left(b, spot - 1) || c || substr(b, spot) AS full_ FROM (SELECT word, spot, unnest([b, replace(b, 'k', 'c')]) AS b FROM i), (SELECT unnest(string_split('bcdfghjklmnñpqrstvwxyz', '')) AS c)),
 mid AS (SELECT word, 5 AS tier, 'internal_apos' AS kind, min(full_) AS full_ FROM j WHERE full_ IN (SELECT word FROM k) GROUP BY word HAVING count(*) = 1),
 map AS (SELECT w.word, 0 AS tier, 'mapping' AS kind, k.word AS full_ FROM w JOIN k ON length(k.word) = 2 AND w.word = k.word || '’'),
 c AS (SELECT * FROM (SELECT word, tier, kind, full_ FROM one UNION ALL SELECT word, tier, kind, full_ FROM last_ WHERE full_ IS NOT NULL UNION ALL SELECT word, tier, kind, full_ FROM mid UNION ALL SELECT word, tier, kind, full_ FROM map)
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY tier) = 1),
 hop AS (SELECT c.full_, regexp_replace(c.full_, ending || '$', r.full_) AS next, place, CASE WHEN base IS NOT NULL THEN regexp_replace(c.full_, ending || '$', base) ELSE regexp_replace(c.full_, ending || '$', r.full_) END AS need
  FROM (SELECT DISTINCT full_ FROM c WHERE full_ NOT IN (SELECT word FROM k)) c JOIN r ON r.tier = 6 AND regexp_matches(c.full_, '^.+' || ending || '$')),
 hops AS (SELECT * FROM hop WHERE need IN (SELECT word FROM k) QUALIFY row_number() OVER (PARTITION BY full_ ORDER BY place) = 1),
 links AS (SELECT word, coalesce(next, c.full_) AS target, kind FROM c LEFT JOIN hops ON hops.full_ = c.full_)"""
ORACLES = {
    "elision_chain": f"WITH {CHAIN} SELECT word, target, kind FROM links",
    "elision_counts": f"""WITH {CHAIN}, o AS (SELECT coalesce(target, word) AS target, word, song, n FROM sung LEFT JOIN links USING (word))
SELECT target AS word, CAST(sum(n) AS BIGINT) AS uses, count(DISTINCT song) AS songs, count(DISTINCT word) AS variants FROM o GROUP BY target""",
}
