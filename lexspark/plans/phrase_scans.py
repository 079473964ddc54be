"""Queries that find an inventory of phrases in lines (TOK07, TOK09, AGG27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import lines as L
from lexspark.operators import phrases as P
from lexspark.session import table

TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"


def _inventory(spark, sf_dir):
    """All part names, and what each benchmark item begins with: its first two to eight words, each."""
    items = table(spark, sf_dir, "benchmark").select(T.tokens(F.col("text")).alias("w"))
    items = items.select(F.explode(F.expr("transform(sequence(2, 8), n -> array_join(slice(w, 1, n), ' '))")).alias("phrase"))
    parts = table(spark, sf_dir, "part").select(F.array_join(T.tokens(F.col("p_name")), " ").alias("phrase"))
    return items.union(parts)


def phrase_places(spark, sf_dir):
    """TOK09: how often each phrase of the inventory stands in documents' lines, inside longer ones too, and in how many documents."""
    places = P.phrase_places(L.tokenised(table(spark, sf_dir, "documents")), _inventory(spark, sf_dir), ["doc_id", "line_no"])
    return places.groupBy("phrase").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs"))


def phrase_scan(spark, sf_dir):
    """TOK07: the phrases of the inventory that a scan of each line takes, longest first, without overlap."""
    keys = ["doc_id", "line_no"]
    places = P.phrase_places(L.tokenised(table(spark, sf_dir, "documents")), _inventory(spark, sf_dir), keys)
    return P.leftmost_longest(places, keys)


QUERIES = {f.__name__: f for f in (phrase_places, phrase_scan)}

PLACES = f"""inv AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS phrase FROM (SELECT regexp_extract_all(lower(text), '{TOKEN}') AS w, unnest(range(2, 9)) AS n FROM benchmark)
  UNION SELECT array_to_string(regexp_extract_all(lower(p_name), '{TOKEN}'), ' ') FROM part),
 p AS (SELECT phrase, len(string_split(phrase, ' ')) AS n FROM inv WHERE len(string_split(phrase, ' ')) BETWEEN 2 AND 8),
 l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, regexp_extract_all(lower(unnest(s)), '{TOKEN}') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
 g AS (SELECT doc_id, line_no, i, n, array_to_string(w[i + 1:i + n], ' ') AS phrase FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM l, (SELECT unnest(range(2, 9)) AS n) WHERE len(w) >= n)),
 m AS (SELECT doc_id, line_no, i, n, phrase FROM g JOIN p USING (phrase, n))"""
ORACLES = {
    "phrase_places": f"WITH {PLACES} SELECT phrase, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM m GROUP BY phrase",
    "phrase_scan": f"""WITH RECURSIVE {PLACES}, b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, i ORDER BY n DESC) = 1),
 r AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) = 1
  UNION ALL SELECT b.* FROM r JOIN b ON b.doc_id = r.doc_id AND b.line_no = r.line_no AND b.i >= r.i + r.n QUALIFY row_number() OVER (PARTITION BY b.doc_id, b.line_no ORDER BY b.i) = 1)
SELECT * FROM r""",
}
