"""The gate of examples with its sixteen reasons on Spanish sentences and what can be wrong with them (FLT04, SRC04, AGG35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import example_gate as G
from lexspark.operators import lines as L
from lexspark.operators import selection as S
from lexspark.session import cut, table

LOW, HIGH = "a-záéíóúüñ", "A-ZÁÉÍÓÚÜÑ"


def _pairs(spark, sf_dir):
    """Sentences of Spanish documents with the sentence before as their English; every 17th to 17th has one of 16 faults."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("i", "s")).where("length(s) between 24 and 110")
    other = F.concat(F.regexp_replace(F.lower("s"), "[aeo]", "e"), F.lit(" x"))
    k = F.pmod(F.col("doc_id") + F.col("i"), F.lit(34))
    s = F.col("s")
    sentence = (
        F.when(k == 0, F.concat(s, F.lit(".."))).when(k == 1, F.regexp_replace(s, "[.!?]$", "")).when(k == 2, F.concat(F.lit("- "), s)).when(k == 3, F.upper("s"))
        .when(k == 4, F.concat(F.regexp_replace(s, "[.!?]$", ""), F.lit(" De la."))).when(k == 5, F.concat(F.lit("("), F.regexp_replace(s, "[.!?]$", ")."))).when(k == 6, F.concat(F.lit("<i> "), s)).otherwise(s)
    )
    english = F.when(k == 7, F.lit(" ")).when(k == 8, F.concat(other, F.lit("..."))).when(k == 9, F.concat(other, F.lit(" "), other, F.lit(" "), other)).when(k == 10, s).otherwise(other)
    toks = F.regexp_extract_all(s, F.lit("[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"), F.lit(0))
    word = F.when(k == 11, F.lit("nunca")).otherwise(F.lower(F.get(toks, F.pmod(F.col("doc_id"), F.greatest(F.size(toks), F.lit(1))).cast("int"))))
    return parts.select(F.concat_ws(":", "doc_id", "i").alias("id"), sentence.alias("sentence"), english.alias("english"), F.coalesce(word, F.lit("")).alias("word"))


def example_reasons(spark, sf_dir):
    """FLT04, SRC04: the first of sixteen reasons against each pair, and the score of accepted ones."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    ranks = cut(S.ranked(L.word_counts(docs), "corpus_count", "word").select("word", (F.col("rank") - 1).alias("rank")), "ranks")
    finite = ranks.where(F.col("word").rlike("(o|as|an)$") & (F.length("word") > 3)).select("word")
    return G.gate(_pairs(spark, sf_dir), ranks, finite).select("id", "word", "reason", "score")


def example_tallies(spark, sf_dir):
    """AGG35: pairs by reason, accepted ones too, and the words they are for."""
    rows = example_reasons(spark, sf_dir)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("pairs"), F.count_distinct("word").alias("words"))


QUERIES = {f.__name__: f for f in (example_reasons, example_tallies)}

TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"
WORD = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"
REASONED = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'es'), dl AS (SELECT DISTINCT doc_id, array_to_string(regexp_extract_all(lower(line), '{TOKEN}'), ' ') AS key FROM l),
 c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(key, ' ')) AS word FROM dl WHERE key <> '') GROUP BY word), k AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM c),
 f AS (SELECT word FROM k WHERE regexp_matches(word, '(o|as|an)$') AND length(word) > 3),
 x AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE lang = 'es'),
 y AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM x), z AS (SELECT doc_id, i, s, (doc_id + i) % 34 AS m, regexp_replace(lower(s), '[aeo]', 'e', 'g') || ' x' AS o, regexp_replace(s, '[.!?]$', '') AS b, regexp_extract_all(s, '{WORD}') AS t FROM y WHERE length(s) BETWEEN 24 AND 110),
 p AS (SELECT doc_id || ':' || i AS id, CASE m WHEN 0 THEN s || '..' WHEN 1 THEN b WHEN 2 THEN '- ' || s WHEN 3 THEN upper(s) WHEN 4 THEN b || ' De la.' WHEN 5 THEN '(' || CASE WHEN b = s THEN s ELSE b || ').' END WHEN 6 THEN '<i> ' || s ELSE s END AS es,
  CASE m WHEN 7 THEN ' ' WHEN 8 THEN o || '...' WHEN 9 THEN o || ' ' || o || ' ' || o WHEN 10 THEN s ELSE o END AS en, coalesce(CASE WHEN m = 11 THEN 'nunca' ELSE lower(t[doc_id % greatest(len(t), 1) + 1]) END, '') AS word FROM z),
 q AS (SELECT *, regexp_extract_all(es, '{WORD}') AS raw, regexp_extract_all(lower(es), '[{LOW}]+') AS toks, regexp_split_to_array(es, ' +') AS sp, regexp_split_to_array(trim(es, ' '), '[ \\t\\n\\r]+') AS ws, regexp_split_to_array(trim(en, ' '), '[ \\t\\n\\r]+') AS we FROM p),
 u AS (SELECT id, unnest(toks) AS w FROM q), e AS (SELECT id, count(*) FILTER (f.word IS NOT NULL) AS clauses, count(*) FILTER (rank IS NULL OR rank >= 5000) AS hard, count(*) FILTER (rank < 5000) AS easy FROM u LEFT JOIN k ON k.word = w LEFT JOIN f ON f.word = w GROUP BY id),
 h AS (SELECT id, lower(regexp_extract(sp[j], '^[{HIGH}][{LOW}]+')) AS w FROM (SELECT id, sp, unnest(range(2, len(sp) + 1)) AS j FROM q) WHERE regexp_matches(sp[j - 1], '[{LOW}]$') AND regexp_matches(sp[j], '^[{HIGH}][{LOW}]+')),
 g AS (SELECT DISTINCT id FROM h JOIN k ON k.word = h.w),
 r AS (SELECT q.*, coalesce(clauses, 0) AS clauses, coalesce(hard, 0) AS hard, coalesce(easy, 0) AS easy, list_filter(range(1, len(raw) + 1), lambda j: lower(raw[j]) = word) AS spots, g.id IS NOT NULL AS merged FROM q LEFT JOIN e USING (id) LEFT JOIN g USING (id)),
 d AS (SELECT *, CASE WHEN len(raw) NOT BETWEEN 5 AND 11 THEN 'length' WHEN len(spots) = 0 THEN 'target absent' WHEN len(list_filter(spots, lambda j: NOT (regexp_matches(raw[j], '^[{HIGH}]') AND j > 1))) = 0 THEN 'proper noun'
  WHEN regexp_matches(rtrim(es), '(\\.\\.|…)$') THEN 'trailing ellipsis' WHEN NOT regexp_matches(rtrim(es), '[.!?"»]$') THEN 'no terminal punct' WHEN regexp_matches(ltrim(es), '^[-–—]') THEN 'dialogue dash' WHEN es = upper(es) AND length(es) > 8 THEN 'all caps' WHEN merged THEN 'merged lines'
  WHEN regexp_matches(es, '[()]') THEN 'parenthetical' WHEN regexp_matches(es, '[♪<>{{}}]|https?://|[0-9]{{3,}}') THEN 'junk chars' WHEN trim(en) = '' THEN 'no english' WHEN regexp_matches(rtrim(en), '(\\.\\.\\.|…)$') THEN 'english fragment'
  WHEN len(we) / len(ws) NOT BETWEEN 0.5 AND 2.0 THEN 'length ratio' WHEN lower(trim(en)) = lower(trim(es)) THEN 'identical sides' WHEN clauses = 0 THEN 'no finite verb' WHEN clauses > 2 THEN '3+ clauses' END AS reason FROM r)"""
SUB = "'que', 'cuando', 'aunque', 'porque', 'si', 'mientras', 'quien', 'cual', 'donde'"
ORACLES = {
    "example_reasons": f"""WITH {REASONED} SELECT id, word, reason, CASE WHEN reason IS NULL THEN round(easy / len(toks) - CASE WHEN hard <= 1 THEN 0 WHEN hard = 2 THEN 0.15 ELSE 0.15 + 0.25 * (hard - 2) END - 0.10 * least(length(es) - length(replace(es, ',', '')), 2)
 - 0.06 * greatest(0, len(list_filter(toks, lambda w: w IN ({SUB}))) - 1) - CASE WHEN regexp_matches(es, '["«»“”]') THEN 0.12 ELSE 0 END + 0.08 + 0.10 * (1 - abs(len(toks) - 8.0) / 8.0), 6) END AS score FROM d""",
    "example_tallies": f"WITH {REASONED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS pairs, count(DISTINCT word) AS words FROM d GROUP BY 1",
}
