"""Queries that rank, select and evaluate (WIN03-32, AGG15-22, AGG30, AGG36, FLT23, FLT24)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators import bands as B
from lexspark.operators import selection as S
from lexspark.session import dealt, table


def bounded_topk(spark, sf_dir):
    """WIN04: the best lines of each part, more for common ones (cap 2, or 4 from 20 lines on)."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    caps = items.groupBy("l_partkey").agg(F.when(F.count("*") >= 20, 4).otherwise(2).alias("cap"))
    best = S.top_k(items, ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 4)
    return best.join(caps, "l_partkey").where("place <= cap").select("l_partkey", "l_orderkey", "l_linenumber", "place")


def set_cover_examples(spark, sf_dir):
    """WIN03, UDF07: for each part brand up to 3 of its 200 first parts' orders that cover most suppliers (rows only)."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    orders = items.groupBy("p_brand", "l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("parts"))
    pool = S.top_k(orders, ["p_brand"], [F.desc(F.size("parts")), F.col("l_orderkey")], 200)
    return S.greedy_cover(pool, "p_brand", "l_orderkey", "parts", "place", 3)


def diverse_choice(spark, sf_dir):
    """WIN05: for each customer the dearest orders, one for each priority and month, up to 3."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    one = S.top_k(orders, ["o_custkey", "month"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1, "p")
    one = S.top_k(one, ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1, "p")
    return S.top_k(one, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


def rerank5(spark, sf_dir):
    """WIN07: parts by uses, price, suppliers, brand and length of name, ranked within each type."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"), F.count_distinct("l_suppkey").alias("suppliers"))
    parts = table(spark, sf_dir, "part").join(uses, F.col("p_partkey") == F.col("l_partkey"))
    order = [F.desc("uses"), F.col("p_retailprice"), F.desc("suppliers"), F.col("p_brand"), F.length("p_name"), F.col("p_partkey")]
    return parts.select("p_partkey", "p_type", F.row_number().over(W.partitionBy("p_type").orderBy(*order)).alias("rank"))


def study_bands(spark, sf_dir):
    """WIN08: parts by uses in bands of near-equal size, cut at drops in use."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    return B.study_bands(uses, "uses")


def lemma_representative(spark, sf_dir):
    """WIN10, WIN11: one part for each name: most uses, then least key."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    parts = table(spark, sf_dir, "part").join(uses, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return S.top_k(parts, ["p_name"], [F.desc("uses"), F.col("p_partkey")], 1).select("p_name", "p_partkey", "uses")


def category_blocks(spark, sf_dir):
    """WIN12: ranks in blocks of categories by size, then name; the first and exclusive last of each."""
    sizes = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    order = W.orderBy(F.desc("n"), "p_type").rowsBetween(W.unboundedPreceding, 0)
    return sizes.withColumn("end", F.sum("n").over(order)).select("p_type", (F.col("end") - F.col("n") + 1).alias("first"), (F.col("end") + 1).alias("end"))


def relevance_sort(spark, sf_dir):
    """WIN14, WIN15: the first three lines of each document by length band, distance from ten words, then place."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("n", F.size(F.split(F.trim("line"), " +"))).where("trim(line) <> ''")
    band = F.when(F.col("n") <= 10, 0).otherwise(1 + F.floor((F.col("n") - 11) / 4)).cast("int")
    rows = lines.withColumn("band", band)
    return S.top_k(rows, ["doc_id"], [F.col("band"), F.abs(F.col("n") - 10), F.col("line_no")], 3).select("doc_id", "line_no", "band", "place")


def reverse_cue_meanings(spark, sf_dir):
    """WIN16: for each brand up to four types, one for each size first (in the order of price), in source order."""
    parts = table(spark, sf_dir, "part")
    group = F.row_number().over(W.partitionBy("p_brand", "p_size").orderBy(F.desc("p_retailprice"), "p_partkey"))
    rows = S.top_k(parts.withColumn("turn", group), ["p_brand"], [F.col("turn"), F.desc("p_retailprice"), F.col("p_partkey")], 4)
    return rows.select("p_brand", "p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("shown"))


def longest_run(spark, sf_dir):
    """WIN17: for each user the longest run of events of one type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    own = W.partitionBy("user_id").orderBy("event_id")
    fresh = events.withColumn("new", F.coalesce(F.lag("event_type").over(own) != F.col("event_type"), F.lit(True)))
    rows = S.islands(fresh, ["user_id"], "event_id", F.col("new"))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


def stutter_islands(spark, sf_dir):
    """WIN18: stretches of two or more words of at most three letters in a line."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = words.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("i", "w")).withColumn("short", F.length("w").between(1, 3))
    rows = S.islands(words, ["doc_id", "line_no"], "i", ~F.col("short")).where("short")
    runs = rows.groupBy("doc_id", "line_no", "island").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("n >= 2")
    return runs.select("doc_id", "line_no", "first", "n")


def yield_at_p(spark, sf_dir):
    """WIN21: labelled documents by length, as long as 90 % are good."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.yield_at(rows, "n_chars", "quality", 0.9, "doc_id")


def keep_top_rates(spark, sf_dir):
    """WIN22, WIN23: the share of good documents among the longest 10, 25, 50, 75 and 100 %."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = rows.agg(F.count("*").alias("n"))
    ranked = S.ranked(rows.select("quality", "n_chars"), "n_chars", None).join(F.broadcast(n), F.lit(True))
    ranked = ranked.withColumn("r", (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("n") - 1))
    cuts = F.explode(F.array(*[F.lit(c) for c in (10, 25, 50, 75, 100)])).alias("cut")
    return ranked.select("quality", "r", cuts).where("r * 100 <= cut").groupBy("cut").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"))


def escalation_budget(spark, sf_dir):
    """WIN24: events whose value is at most that at the place of the lowest 20 %, counted by type."""
    events = table(spark, sf_dir, "events")
    cut = events.agg(F.expr("percentile_disc(0.2) WITHIN GROUP (ORDER BY value)").alias("cut"))
    return events.join(F.broadcast(cut), F.lit(True)).where("value <= cut").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def reject_then_top(spark, sf_dir):
    """WIN25: of each user's events of a value from 20 on, the five highest, in their first order."""
    events = table(spark, sf_dir, "events").where("value >= 20")
    return S.top_k(events, ["user_id"], [F.desc("value"), F.col("event_id")], 5).select(
        "user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("shown")
    )


def hash_sample(spark, sf_dir):
    """WIN26-28, WIN30: three events of each type and user by SHA-256."""
    events = table(spark, sf_dir, "events").withColumn("h", S.hash_priority("audit-1", F.col("event_id")))
    return S.top_k(events, ["user_id", "event_type"], [F.col("h"), F.col("event_id")], 3).select("user_id", "event_type", "event_id", "place")


def hash_split(spark, sf_dir):
    """WIN29: part names split 35 to 65 by SHA-1."""
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    return parts.select("p_name", S.hash_split(F.col("p_name"), 35).alias("dev"))


def split_largest_remainder(spark, sf_dir):
    """AGG36: an order's rounded price dealt over its lines by quantity."""
    items = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor("o_totalprice").alias("total"))
    rows = S.largest_remainder(items.join(orders, "l_orderkey"), ["l_orderkey"], "total", "l_quantity", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "part")


def easiness(spark, sf_dir):
    """AGG30: the whole part of the exact median rank of an order's parts; parts beyond rank 1500 count as 999999."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    levels = S.numbered(uses.select("uses").distinct(), [F.desc("uses")])
    ranks = uses.join(levels, "uses").select("l_partkey", "rank")
    rank = F.when(F.col("rank") <= 1500, F.col("rank")).otherwise(999_999)
    rows = table(spark, sf_dir, "lineitem").join(ranks, "l_partkey").withColumn("rank", rank)
    return rows.groupBy("l_orderkey").agg(F.floor(F.percentile("rank", 0.5)).alias("easiness"))


def prominence(spark, sf_dir):
    """AGG15-17: shares of event types for each user, with speech bands (.50, .15, .03) and pivot bands (.55, .20, .05)."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("user_id"))
    band = lambda a, b, c: F.when(F.col("share") >= a, "main").when(F.col("share") >= b, "common").when(F.col("share") >= c, "rare").otherwise("trace")
    rows = counts.withColumn("share", F.round(share, 6))
    return rows.select("user_id", "event_type", "share", band(0.5, 0.15, 0.03).alias("speech"), band(0.55, 0.2, 0.05).alias("pivot"))


def evidence_coverage(spark, sf_dir):
    """AGG18: how many of each brand's parts an order uses; 100.0 if it has none."""
    parts, used = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    rows = parts.join(used, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(F.count("l_partkey").alias("met"), F.count("*").alias("n"))
    pct = F.when(F.col("n") == 0, 100.0).otherwise(F.round(100 * F.col("met") / F.col("n"), 4))
    return rows.select("p_brand", "met", (F.col("n") - F.col("met")).alias("missing"), pct.alias("pct"))


def micro_macro(spark, sf_dir):
    """AGG21: quality of labelled documents over all and as a mean over sources, by length bucket of 500 up to 5000."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    bucket = F.least(F.floor(F.col("n_chars") / 500) * 500, F.lit(5000)).cast("long")
    each = rows.groupBy(bucket.alias("bucket"), "source").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return each.groupBy("bucket").agg(F.round(F.sum("good") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("good") / F.col("n")), 6).alias("macro"))


def panel_prf(spark, sf_dir):
    """AGG22: a rule (fewer than a tenth of symbols) against quality labels: counts, precision, recall and coverage."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    odd = F.length(F.regexp_replace("text", r"[^!#$%&*|]", "")) * 10 < F.size(F.split("text", " "))
    c = rows.select(odd.alias("p"), (F.col("quality") == 1).alias("y")).agg(
        F.count_if(F.expr("p and y")).alias("tp"), F.count_if(F.expr("p and not y")).alias("fp"), F.count_if(F.expr("not p and not y")).alias("tn"),
        F.count_if(F.expr("not p and y")).alias("fn"), F.count("*").alias("n"), F.count("y").alias("labelled"),
    )
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return c.select("tp", "fp", "tn", "fn", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    rate(F.col("labelled"), F.col("n")).alias("coverage"))


def deck_defects(spark, sf_dir):
    """FLT23, FLT24: the number of lines with each defect."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    n = F.size(F.split(F.trim("line"), " +"))
    flags = {
        "blank": F.trim("line") == "", "verbose": n > 40, "semicolon": F.col("line").contains(";"), "trailing stop": F.col("line").endswith("."),
        "shouting": (F.col("line") == F.upper("line")) & F.col("line").rlike("[A-Z]{3}"), "bars": F.col("line").contains("|"),
    }
    sums = lines.agg(*[F.count_if(f).alias(k) for k, f in flags.items()])
    return sums.unpivot([], list(flags), "defect", "n")


QUERIES = {
    f.__name__: f
    for f in (
        bounded_topk, set_cover_examples, diverse_choice, rerank5, study_bands, lemma_representative, category_blocks, relevance_sort,
        reverse_cue_meanings, longest_run, stutter_islands, yield_at_p, keep_top_rates, escalation_budget, reject_then_top, hash_sample,
        hash_split, split_largest_remainder, easiness, prominence, evidence_coverage, micro_macro, panel_prf, deck_defects,
    )
}

USES = "uses AS (SELECT l_partkey, count(*) AS uses, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey)"
LINES = "lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
BAND = "CASE WHEN share >= %s THEN 'main' WHEN share >= %s THEN 'common' WHEN share >= %s THEN 'rare' ELSE 'trace' END"
ORACLES = {
    "bounded_topk": """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
 SELECT l_partkey, l_orderkey, l_linenumber, place FROM r WHERE place <= CASE WHEN n >= 20 THEN 4 ELSE 2 END""",
    "diverse_choice": """WITH a AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) = 1),
 b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1), c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM b)
 SELECT * FROM c WHERE place <= 3""",
    "rerank5": f"WITH {USES} SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY uses DESC, p_retailprice, suppliers DESC, p_brand, length(p_name), p_partkey) AS rank FROM part JOIN uses ON p_partkey = l_partkey",
    "study_bands": f"""WITH RECURSIVE {USES}, r AS (SELECT uses, row_number() OVER (ORDER BY uses DESC, l_partkey) AS rank FROM uses),
 s AS (SELECT *, least(total, 80, greatest(10, CAST(ceil(total / 200) AS BIGINT))) AS bands FROM (SELECT count(*) AS total, sum(uses) AS all_uses FROM r)),
 p AS (SELECT *, greatest(2, CAST(floor(total / bands * 0.25 + 0.5) AS BIGINT)) AS snap, greatest(1, CAST(floor(total / bands * 0.5 + 0.5) AS BIGINT)) AS low FROM s),
 l AS (SELECT list(rank) AS drops FROM (SELECT rank, uses, lead(uses) OVER (ORDER BY rank) AS next FROM r) WHERE next < uses),
 b AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS cut, total, bands, snap, low, drops FROM p, l UNION ALL
  SELECT k + 1, CASE WHEN k + 1 = bands THEN total ELSE coalesce(list_min(list_transform(list_filter(drops, lambda d: d >= cut + low AND d <= total - (bands - k - 1) * low AND abs(d - aim) <= snap), lambda d: {{'far': abs(d - aim), 'd': d}})).d, aim) END,
   total, bands, snap, low, drops FROM (SELECT *, greatest(cut + low, least(total - (bands - k - 1) * low, CAST(floor(total * (k + 1) / bands + 0.5) AS BIGINT))) AS aim FROM b WHERE k < bands)),
 e AS (SELECT k AS band, lag(cut) OVER (ORDER BY k) AS first, cut FROM b)
SELECT band, first + 1 AS start, cut - first AS cards, x.uses AS least_uses, coalesce(y.uses = x.uses, false) AS split, (SELECT round(100 * sum(uses) / (SELECT sum(uses) FROM r), 3) FROM r WHERE rank <= cut) AS coverage
 FROM e JOIN r x ON x.rank = cut LEFT JOIN r y ON y.rank = cut + 1 WHERE band > 0""",
    "lemma_representative": f"WITH {USES} SELECT p_name, p_partkey, coalesce(uses, 0) AS uses FROM part LEFT JOIN uses ON p_partkey = l_partkey QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY coalesce(uses, 0) DESC, p_partkey) = 1",
    "category_blocks": """WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), e AS (SELECT *, sum(n) OVER (ORDER BY n DESC, p_type) AS e FROM s) SELECT p_type, e - n + 1 AS first, e + 1 AS "end" FROM e""",
    "relevance_sort": f"""WITH {LINES}, n AS (SELECT doc_id, line_no, len(regexp_split_to_array(trim(line, ' '), ' +')) AS n FROM lines WHERE trim(line, ' ') <> ''), b AS (SELECT *, CASE WHEN n <= 10 THEN 0 ELSE 1 + (n - 11) // 4 END AS band FROM n),
 r AS (SELECT doc_id, line_no, band, row_number() OVER (PARTITION BY doc_id ORDER BY band, abs(n - 10), line_no) AS place FROM b) SELECT * FROM r WHERE place <= 3""",
    "reverse_cue_meanings": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY turn, p_retailprice DESC, p_partkey) AS place FROM t)
 SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS shown FROM k WHERE place <= 4""",
    "longest_run": """WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
 r AS (SELECT user_id, count(*) AS n FROM n GROUP BY user_id, event_type, g) SELECT user_id, max(n) AS longest, count(*) AS runs FROM r GROUP BY user_id""",
    "stutter_islands": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(s) AS w, unnest(range(len(s))) AS i FROM (SELECT doc_id, line_no, string_split(line, ' ') AS s FROM lines)), k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS g FROM w WHERE length(w) BETWEEN 1 AND 3)
 SELECT doc_id, line_no, min(i) AS first, count(*) AS n FROM k GROUP BY doc_id, line_no, g HAVING count(*) >= 2""",
    "yield_at_p": """WITH c AS (SELECT n_chars, count(*) AS n, sum(quality) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT n_chars, sum(n) OVER w AS n, sum(good) OVER w AS good FROM c WINDOW w AS (ORDER BY n_chars DESC))
 SELECT coalesce(max(n), 0) AS n, min(n_chars) AS cut FROM r WHERE good >= n * 0.9""",
    "keep_top_rates": """WITH r AS (SELECT quality, percent_rank() OVER (ORDER BY n_chars DESC) AS r FROM documents JOIN labels USING (doc_id)) SELECT cut, count(*) AS n, round(avg(quality), 6) AS good FROM r, (SELECT unnest([10, 25, 50, 75, 100]) AS cut) WHERE r * 100 <= cut GROUP BY cut""",
    "escalation_budget": "SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE value <= (SELECT quantile_disc(value, 0.2) FROM events) GROUP BY event_type",
    "reject_then_top": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events WHERE value >= 20) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS shown FROM r WHERE place <= 5""",
    "hash_sample": """WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY left(sha256('audit-1|' || event_id), 16), event_id) AS place FROM events) SELECT * FROM r WHERE place <= 3""",
    "hash_split": "SELECT p_name, CAST('0x' || left(sha1(p_name), 8) AS BIGINT) % 100 < 35 AS dev FROM (SELECT DISTINCT p_name FROM part)",
    "split_largest_remainder": """WITH j AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(floor(o_totalprice) AS BIGINT) AS total, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS w, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 e AS (SELECT *, CASE WHEN w > 0 THEN total * l_quantity / w ELSE total / n END AS x FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(x - floor(x), 9) DESC, l_quantity DESC, l_linenumber) AS k, total - sum(floor(x)) OVER (PARTITION BY l_orderkey) AS rest FROM e)
 SELECT l_orderkey, l_linenumber, CAST(floor(x) AS BIGINT) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS part FROM r""",
    "easiness": f"""WITH {USES}, r AS (SELECT l_partkey, dense_rank() OVER (ORDER BY uses DESC) AS rank FROM uses) SELECT l_orderkey, CAST(floor(quantile_cont(CASE WHEN rank <= 1500 THEN rank ELSE 999999 END, 0.5)) AS BIGINT) AS easiness FROM lineitem JOIN r USING (l_partkey) GROUP BY l_orderkey""",
    "prominence": f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c)
 SELECT user_id, event_type, share, {BAND % (0.5, 0.15, 0.03)} AS speech, {BAND % (0.55, 0.2, 0.05)} AS pivot FROM s""",
    "evidence_coverage": """WITH u AS (SELECT DISTINCT l_partkey FROM lineitem) SELECT p_brand, count(l_partkey) AS met, count(*) - count(l_partkey) AS missing, round(100 * count(l_partkey) / count(*), 4) AS pct FROM part LEFT JOIN u ON p_partkey = l_partkey GROUP BY p_brand""",
    "micro_macro": """WITH e AS (SELECT least(n_chars // 500 * 500, 5000) AS bucket, source, sum(quality) AS good, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT bucket, round(sum(good) / sum(n), 6) AS micro, round(avg(good / n), 6) AS macro FROM e GROUP BY bucket""",
    "panel_prf": """WITH r AS (SELECT length(regexp_replace(text, '[^!#$%&*|]', '', 'g')) * 10 < len(string_split(text, ' ')) AS p, quality = 1 AS y FROM documents LEFT JOIN labels USING (doc_id)),
 c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn, count(*) AS n, count(y) AS labelled FROM r)
 SELECT tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, round(labelled / n, 6) AS coverage FROM c""",
    "deck_defects": f"""WITH {LINES}, f AS (SELECT unnest(['blank', 'verbose', 'semicolon', 'trailing stop', 'shouting', 'bars']) AS defect, unnest([trim(line, ' ') = '', len(regexp_split_to_array(trim(line, ' '), ' +')) > 40, contains(line, ';'), ends_with(line, '.'),
 line = upper(line) AND regexp_matches(line, '[A-Z]{{3}}'), contains(line, '|')]) AS hit FROM lines) SELECT defect, count(*) FILTER (hit) AS n FROM f GROUP BY defect""",
}
