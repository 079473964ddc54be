"""A query on long glosses cut for cards, made of what is known of parts (PRJ11, PRJ10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import gloss_segments
from lexspark.session import table


def card_glosses(spark, sf_dir):
    """PRJ11: glosses of parts with repeated parts, brackets, four clauses and a long run, as a card shows them."""
    # a row costs far more than its bytes tell, so rows are dealt out, whatever the number of files
    p = table(spark, sf_dir, "part").repartition("p_partkey").withColumn("w", F.split("p_name", " "))
    a, b = F.col("w")[0], F.col("w")[1]
    gloss = F.concat(
        a, F.lit(", "), b, F.lit("; to "), a, F.lit(" ("), b, F.lit(", "), F.lower("p_type"), F.lit("); To "), a, F.lit(", "), b, F.right(b, F.lit(1)), F.lit(", of the size "),
        F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ", sold at a low price, ").otherwise(", sold, "), F.lower("p_brand"), F.lit("; "), b, F.lit(" things; plain"),
    )
    return p.select("p_partkey", gloss_segments.card_gloss(gloss).alias("gloss"))


QUERIES = {"card_glosses": card_glosses}

KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(part)), '[‘’“”]', '''', 'g'), '^to\\s+', ''), '[.,;:''\"]+$', ''), '\\s+', ' ', 'g'))"
ORACLES = {
    "card_glosses": f"""WITH w AS (SELECT *, string_split(p_name, ' ') AS w FROM part),
 g AS (SELECT p_partkey, w[1] || ', ' || w[2] || '; to ' || w[1] || ' (' || w[2] || ', ' || lower(p_type) || '); To ' || w[1] || ', ' || w[2] || right(w[2], 1) || ', of the size ' || p_size
  || CASE WHEN p_partkey % 3 = 0 THEN ', sold at a low price, ' ELSE ', sold, ' END || lower(p_brand) || '; ' || w[2] || ' things; plain' AS t FROM w),
 c AS (SELECT p_partkey, unnest(range(1, length(t) + 1)) AS i, unnest(string_split(t, '')) AS c FROM g), d AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth, lead(c) OVER (PARTITION BY p_partkey ORDER BY i) AS next FROM c),
 m AS (SELECT *, depth = 0 AND c IN (';', ',') AND next = ' ' AS sep FROM d), n AS (SELECT *, coalesce(sum(CAST(sep AS INT)) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM m),
 s AS (SELECT p_partkey, seg, trim(string_agg(c, '' ORDER BY i) FILTER (NOT sep)) AS part, lag(max(c) FILTER (sep)) OVER (PARTITION BY p_partkey ORDER BY seg) AS mark FROM n GROUP BY p_partkey, seg),
 k AS (SELECT *, {KEY} AS key FROM s),
 f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.p_partkey = k.p_partkey AND o.seg < k.seg AND (o.key = k.key OR (k.key = o.key || right(o.key, 1) AND length(k.key) > 1) OR (o.key = k.key || right(k.key, 1) AND length(o.key) > 1)))),
 q AS (SELECT *, sum(CASE WHEN mark = ';' THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY seg) AS clause FROM f),
 r AS (SELECT *, count(*) OVER (PARTITION BY p_partkey, clause) AS size, row_number() OVER (PARTITION BY p_partkey, clause ORDER BY seg) AS place,
  sum(len(regexp_extract_all(part, '\\S+'))) OVER (PARTITION BY p_partkey, clause ORDER BY seg) AS words FROM q WHERE clause < 3),
 x AS (SELECT p_partkey, clause, string_agg(part, ', ' ORDER BY seg) AS t FROM r WHERE size <= 2 OR place = 1 OR words <= 7 GROUP BY ALL)
SELECT p_partkey, string_agg(t, '; ' ORDER BY clause) AS gloss FROM x GROUP BY p_partkey""",
}
