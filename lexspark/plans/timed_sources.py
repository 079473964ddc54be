"""Queries that read structured texts (SRC13, SRC16, SNK01, SNK05, SNK08, FUN04-07, FUN12, TOK04, PRJ03, WIN31)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.session import table
from lexspark.sources import readers, writers


def lrc_windows(spark, sf_dir):
    """SRC16: documents' lines stamped by their number, two at a time alike, as timed lyrics."""
    docs = table(spark, sf_dir, "documents")
    stamped = F.array_join(
        F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.format_string("[%02d:%02d.50]", (F.floor(i / 2) / 60).cast("int"), F.pmod(F.floor(i / 2), F.lit(60)).cast("int")), F.translate(line, "[]", ""))), "\n"
    )
    rows = docs.select("doc_id", stamped.alias("synced"), F.lit(3_600_000).alias("duration_ms"))
    return readers.lrc(rows, "doc_id", "synced", "duration_ms").groupBy("doc_id", "ms", "end_ms").agg(F.count("*").alias("lines"))


def canonical_rows(spark, sf_dir):
    """SNK01: a digest of each nation's canonical JSON."""
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", F.sha2(writers.canonical_json(nation), 256).alias("digest"))


def shard_sizes(spark, sf_dir):
    """SNK05: parts by shards of 150 ranks."""
    parts = table(spark, sf_dir, "part")
    return parts.groupBy(F.floor((F.col("p_partkey") - 1) / 150).alias("shard")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def section_vocalists(spark, sf_dir):
    """PRJ03, WIN31, AGG33: turns as sections: the last user's first word is carried over its conversation's turns; long turns reset it."""
    turns = table(spark, sf_dir, "conversations")
    own = W.partitionBy("conv_id").orderBy("turn")
    name = F.when(F.length("text") > 400, "").when(F.col("role") == "user", F.substring_index("text", " ", 1))
    carried = F.last(name, ignorenulls=True).over(own)
    return turns.select("conv_id", "turn", F.nullif(carried, F.lit("")).alias("vocalist"))


def expand_tokens(spark, sf_dir):
    """TOK04, PRJ05: part names' words, some of which expand to two, with both ordinals."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    pairs = spark.createDataFrame([("almond", ["al", "mond"]), ("blue", ["bl", "ue"]), ("bolt", ["bo", "lt"])], "w string, parts array<string>")
    rows = words.join(F.broadcast(pairs), "w", "left").select("p_partkey", "i", "w", F.posexplode(F.coalesce("parts", F.array("w"))).alias("j", "token"))
    return rows.select("p_partkey", "i", "j", F.col("w").alias("surface"), "token")


def phrase_matches(spark, sf_dir):
    """TOK07, TOK09: benchmark items' first four words looked up in documents by an equi-join of n-grams."""
    grams = lambda df, key: df.select(key, F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ").alias("w"))
    items = grams(table(spark, sf_dir, "benchmark"), "item_id").where("size(w) >= 4").select("item_id", F.array_join(F.slice("w", 1, 4), " ").alias("g"))
    docs = grams(table(spark, sf_dir, "documents"), "doc_id").where("size(w) >= 4")
    docs = docs.select("doc_id", F.explode_outer(F.expr("transform(sequence(0, size(w) - 4), i -> array_join(slice(w, i + 1, 4), ' '))")).alias("g"))
    return docs.join(items, "g").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("uses"))


def json_fields(spark, sf_dir):
    """FUN06: sums of a JSON field by type; bad or missing values are left out."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


def date_grid(spark, sf_dir):
    """FUN07: orders by month, with the days since the first of all."""
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderdate").alias("first"))
    months = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("d"))
    return months.join(F.broadcast(first), F.lit(True)).select("month", "n", F.datediff("d", "first").cast("long").alias("days"))


def count_formats(spark, sf_dir):
    """FUN12: compact counts such as 1.2k, and percent text, of uses by brand."""
    uses = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))
    total = uses.agg(F.sum("n").alias("total"))
    compact = F.when(F.col("n") >= 1000, F.concat((F.floor(F.col("n") / 100) / 10).cast("string"), F.lit("k"))).otherwise(F.col("n").cast("string"))
    return uses.join(F.broadcast(total), F.lit(True)).select("p_brand", compact.alias("shown"), F.concat(F.floor(100 * F.col("n") / F.col("total")).cast("string"), F.lit("%")).alias("pct"))


def counter_map(spark, sf_dir):
    """FUN04, FUN05: for each customer the counts of order priorities as sorted text, most first."""
    each = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    rows = each.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o_orderpriority"))).alias("l"))
    return rows.select("o_custkey", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["o_orderpriority"], -x["m"])), ";").alias("counts"))


QUERIES = {
    f.__name__: f
    for f in (
        lrc_windows, canonical_rows, shard_sizes, section_vocalists, expand_tokens, phrase_matches, json_fields, date_grid, count_formats, counter_map,
    )
}

WORDS = "string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), ' ')"
ORACLES = {
    "lrc_windows": """WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), t AS (SELECT doc_id, i // 2 * 1000 + 500 AS ms, trim(translate(line, '[]', ''), ' ') AS line FROM l),
 e AS (SELECT *, coalesce(min(ms) OVER (PARTITION BY doc_id ORDER BY ms RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 3600000) AS end_ms FROM t) SELECT doc_id, ms, end_ms, count(*) AS lines FROM e WHERE line <> '' GROUP BY ALL""",
    "canonical_rows": """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""",
    "shard_sizes": "SELECT CAST(floor((p_partkey - 1) / 150) AS BIGINT) AS shard, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1",
    "section_vocalists": """WITH n AS (SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN '' WHEN role = 'user' THEN split_part(text, ' ', 1) END AS name FROM conversations)
 SELECT conv_id, turn, nullif(last_value(name IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS vocalist FROM n""",
    "expand_tokens": """WITH w AS (SELECT p_partkey, unnest(s) AS w, unnest(range(len(s))) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)), p AS (SELECT *, CASE w WHEN 'almond' THEN ['al', 'mond'] WHEN 'blue' THEN ['bl', 'ue'] WHEN 'bolt' THEN ['bo', 'lt'] ELSE [w] END AS parts FROM w)
 SELECT p_partkey, i, unnest(range(len(parts))) AS j, w AS surface, unnest(parts) AS token FROM p""",
    "phrase_matches": f"""WITH i AS (SELECT item_id, array_to_string(w[1:4], ' ') AS g FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) >= 4), d AS (SELECT doc_id, array_to_string(w[j:j + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS j FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 4))
 SELECT item_id, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM d JOIN i USING (g) GROUP BY item_id""",
    "json_fields": "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY 1",
    "date_grid": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, date_diff('day', CAST((SELECT min(o_orderdate) FROM orders) AS DATE), CAST(min(o_orderdate) AS DATE)) AS days FROM orders GROUP BY 1",
    "count_formats": """WITH u AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, CASE WHEN n >= 1000 THEN CAST(floor(n / 100) / 10 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END AS shown, CAST(floor(100 * n / (SELECT sum(n) FROM u)) AS BIGINT) || '%' AS pct FROM u""",
    "counter_map": "WITH e AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority || '=' || n, ';' ORDER BY n DESC, o_orderpriority) AS counts FROM e GROUP BY 1",
}
