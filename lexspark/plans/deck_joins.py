"""Queries that join and assemble decks (JOI01-21, AGG06-14, AGG19, AGG20, FLT13-15, SIM18)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators import decks as D
from lexspark.session import table


def index_join_master(spark, sf_dir):
    """JOI01: an order's parallel arrays of parts and quantities against the master of parts, by position."""
    items = table(spark, sf_dir, "lineitem")
    cards = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("s"))
    cards = cards.select("l_orderkey", F.posexplode("s").alias("pos", "s")).select("l_orderkey", "pos", "s.l_partkey", "s.l_quantity")
    master = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    share = F.when(F.col("l_quantity") > 0, F.col("l_quantity")).otherwise(F.lit(1.0))
    return cards.join(master, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "pos", "p_name", share.alias("frequency"))


def stable_id_or_null(spark, sf_dir):
    """JOI03, JOI04: names of lines' suppliers by id (kept for odd lines), else by index."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey") * 2).alias("s_id"), (F.col("l_suppkey") - 1).alias("s_index")
    )
    s = table(spark, sf_dir, "supplier")
    by_id = s.select(F.col("s_suppkey").alias("s_id"), F.col("s_name").alias("name"))
    by_index = s.select((F.col("s_suppkey") - 1).alias("s_index"), F.col("s_name").alias("name"))
    return D.by_id_or_index(items, by_id, by_index, "s_id", "s_index", "name").select("l_orderkey", "l_linenumber", "name")


def section_zip(spark, sf_dir):
    """JOI08: turns of a conversation zipped with the next conversation's only where both have as many, |difference| / most at most a tenth."""
    turns = table(spark, sf_dir, "conversations")
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    pairs = n.join(n.select((F.col("conv_id") - 1).alias("conv_id"), F.col("n").alias("m")), "conv_id")
    fits = pairs.where((F.abs(F.col("n") - F.col("m")) / F.greatest("n", "m") <= 0.1) & (F.col("n") == F.col("m"))).select("conv_id")
    order = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    a = turns.select("conv_id", order.alias("line"), F.length("text").alias("source_chars"))
    b = a.select((F.col("conv_id") - 1).alias("conv_id"), "line", F.col("source_chars").alias("target_chars"))
    return a.join(fits, "conv_id", "left_semi").join(b, ["conv_id", "line"])


def band_align(spark, sf_dir):
    """JOI09: lines of each document near the proportional place (3 either way) of the next document's lines, nearest length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("s"))
    counts = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.size("s").alias("m"))
    lines = docs.join(counts, "doc_id").select("doc_id", "m", F.size("s").alias("n"), F.posexplode("s").alias("i", "line"))
    # each line meets the seven places of its band, not all lines of the other document
    middle = F.floor(F.col("i") * F.col("m") / F.col("n"))
    lines = lines.select("doc_id", "i", F.length("line").alias("len"), F.explode(F.sequence(middle - 3, middle + 3)).alias("j"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.posexplode("s").alias("j", "line")).select("doc_id", F.col("j").cast("long").alias("j"), F.length("line").alias("len_j"))
    met = lines.join(other, ["doc_id", "j"]).withColumn("score", -F.abs(F.col("len") - F.col("len_j")))
    best = met.groupBy("doc_id", "i").agg(F.max(F.struct("score", (-F.col("j")).alias("k"))).alias("b"))
    return best.select("doc_id", "i", (-F.col("b.k")).alias("j"), "b.score").where("score >= -20")


def tiered_match(spark, sf_dir):
    """JOI10, as tiers only (timestamp_matches has the ratio): suppliers to customers: same key and nation, else nearest balance within 10 in the nation, else the nation's first."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("match"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    same = s.join(c, (F.col("s_suppkey") == F.col("match")) & (s.nation == c.nation)).select("s_suppkey", "match")
    near = s.join(c, "nation").where(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) <= 10).select("s_suppkey", "match")
    first = s.join(c.groupBy("nation").agg(F.min("match").alias("match")), "nation").select("s_suppkey", "match")
    return D.tiered(s.select("s_suppkey"), "s_suppkey", [("exact", same), ("near", near), ("nation", first)])


def import_plan(spark, sf_dir):
    """JOI12, SRC13: imported names (of suppliers' numbers) against the index of part names: unmatched, ambiguous or matched."""
    parts = table(spark, sf_dir, "part")
    index = parts.groupBy(F.lower("p_name").alias("surface")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))
    rows = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("no "), "p_name")).alias("entry"))
    out = rows.join(index, F.lower("entry") == F.col("surface"), "left")
    plan = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return out.select("p_partkey", plan.alias("plan"))


def redirect_chase(spark, sf_dir):
    """JOI05: parts redirect to the part of half their key where the name begins alike; chains of up to five hops."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    redirects = parts.where("p_partkey % 3 <> 0 and p_partkey > 1").select(F.col("p_partkey").alias("word"), F.floor(F.col("p_partkey") / 2).alias("base"))
    return D.chase(redirects)


def duplicate_songs(spark, sf_dir):
    """JOI11, SIM18, WIN17: pairs of documents with a run of four shared lines or 30 % of them (labels .80, 6)."""
    pairs = D.shared_lines(table(spark, sf_dir, "documents"))
    label = F.when(F.col("pct") >= 0.8, "near-duplicate").when(F.col("run") >= 6, "shared verse").otherwise("overlap")
    return pairs.withColumn("label", label)


def unique_title_track(spark, sf_dir):
    """JOI17: orders' days to a track only where the customer has one order that day; ambiguous days get none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("title"))
    tracks = orders.groupBy("o_custkey", "title").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("track")).where("n = 1").drop("n")
    return orders.join(tracks, ["o_custkey", "title"], "left").select("o_orderkey", "track")


def translation_priority(spark, sf_dir):
    """JOI19: for each user the newest event of the type of highest priority (purchase, click, signup)."""
    events = table(spark, sf_dir, "events")
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 1)
    rows = events.withColumn("rank", rank).where("rank is not null")
    return rows.groupBy("user_id").agg(F.max(F.struct("rank", "event_id", "event_type")).alias("m")).select("user_id", "m.event_id", "m.event_type")


def two_hop_titles(spark, sf_dir):
    """JOI21: customers to nation, then region; a nation without its region keeps its own name."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region").where("r_regionkey < 4")
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.groupBy(F.coalesce("r_name", "n_name").alias("title")).agg(F.count("*").alias("customers"))


def assemble_cards(spark, sf_dir):
    """JOI02, JOI20: parts with uses, best supplier, first order and price rank: left joins by composite keys."""
    items = table(spark, sf_dir, "lineitem")
    uses = items.groupBy("l_partkey").agg(F.count("*").alias("uses"), F.min("l_orderkey").alias("first_order"))
    each = items.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    best = each.groupBy("l_partkey").agg(F.max(F.struct("q", (-F.col("l_suppkey")).alias("s"))).alias("b")).select("l_partkey", (-F.col("b.s")).alias("l_suppkey"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", rank.alias("price_rank"))
    return cards.join(uses, "l_partkey", "left").join(best, "l_partkey", "left").join(names, "l_suppkey", "left").select(
        "l_partkey", "p_name", "price_rank", F.coalesce("uses", F.lit(0)).alias("uses"), "first_order", "s_name"
    )


def merge_evidence(spark, sf_dir):
    """AGG06: parts by name: counts summed, orders joined (as a number), brands as a map's sorted entries."""
    parts, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    by_brand = rows.groupBy("p_name", "p_brand").agg(F.count("*").alias("n"))
    variants = by_brand.groupBy("p_name").agg(
        F.sum("n").alias("uses"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p_brand", "n"))), ",").alias("variants")
    )
    songs = rows.select("p_name", "l_orderkey").distinct().groupBy("p_name").agg(F.count("*").alias("orders"))
    return variants.join(songs, "p_name")


def merge_by_surface(spark, sf_dir):
    """AGG11: shares of brands within a part name, groups of more evidence first, as two-digit text."""
    rows = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"))
    own = W.partitionBy("p_name")
    order = own.orderBy(F.desc("n"), "p_brand")
    share = F.format_string("%.2f", F.floor(100 * F.col("n") / F.sum("n").over(own)) / 100)
    return rows.select("p_name", "p_brand", F.row_number().over(order).alias("place"), share.alias("share"))


def clitic_fold(spark, sf_dir):
    """AGG12: counts of parts added to the base their key redirects to (modulo 50); bases outside the table keep their own."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    route = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 50 + 1).alias("base"))
    rows = items.join(route, "l_partkey", "left").withColumn("card", F.coalesce("base", "l_partkey"))
    return rows.groupBy("card").agg(F.sum("uses").alias("uses"), F.count("*").alias("forms"))


def merge_sources(spark, sf_dir):
    """AGG13, AGG14: counts of a nation's market segments: the most of a customer's order statuses, summed over customers; flags or-ed."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    each = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.bool_or(F.col("o_totalprice") > 300000).alias("flag"))
    each = each.groupBy("o_custkey").agg(F.max("n").alias("n"), F.bool_or("flag").alias("flag"))
    rows = c.join(each, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("n").alias("n"), F.bool_or("flag").alias("flag"))


def pooled_lemma_frequency(spark, sf_dir):
    """AGG10: different lines of each document by its first word: never capped."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    key = F.lower(F.trim("line"))
    rows = lines.where("trim(line) <> ''").select(F.substring_index(key, " ", 1).alias("lemma"), F.md5(key.cast("binary")).alias("key")).distinct()
    return rows.groupBy("lemma").agg(F.count("*").alias("lines"))


def song_catalog(spark, sf_dir):
    """AGG19, AGG20: for each customer the number of different parts ordered and the first ten by use."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    each = items.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    own = W.partitionBy("o_custkey").orderBy(F.desc("n"), "l_partkey")
    ranked = each.withColumn("place", F.row_number().over(own))
    ten = ranked.where("place <= 10").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("place", "l_partkey"))).alias("t"))
    ten = ten.select("o_custkey", F.array_join(F.col("t.l_partkey").cast("array<string>"), ",").alias("first"))
    return each.groupBy("o_custkey").agg(F.count("*").alias("cards")).join(ten, "o_custkey")


def filtered_deck(spark, sf_dir):
    """FLT13, FLT14: the first reason that hides each part, counted."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    parts = table(spark, sf_dir, "part").join(uses, F.col("p_partkey") == F.col("l_partkey"), "left")
    reasons = [
        ("unused", F.col("uses").isNull()), ("rare", F.col("uses") < 15), ("small", F.col("p_size") < 5),
        ("cheap", F.col("p_retailprice") < 950), ("brand", F.col("p_brand").endswith("5")),
    ]
    return D.first_reason(parts, reasons).groupBy(F.coalesce("reason", F.lit("shown")).alias("reason")).agg(F.count("*").alias("n"))


def song_filter(spark, sf_dir):
    """FLT01, FLT15: parts in the orders of chosen customers (every 40th), without those of excluded orders, in deck order."""
    orders = table(spark, sf_dir, "orders")
    chosen, barred = orders.where("o_custkey % 40 = 0").select("o_orderkey"), orders.where("o_orderstatus = 'P'").select("o_orderkey")
    items = table(spark, sf_dir, "lineitem")
    met = items.join(chosen, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(barred, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return table(spark, sf_dir, "part").join(met, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


def counts_by_grain(spark, sf_dir):
    """Extension: documents and characters by source and language, and their totals, in one pass."""
    docs = table(spark, sf_dir, "documents")
    out = docs.rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("grain"))
    return out.select("source", "lang", "docs", "chars", F.col("grain").cast("long").alias("grain"))


def as_of_join(spark, sf_dir):
    """Extension: each purchase with the same user's last click before it."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    own = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(own)
    return events.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "click_id")


QUERIES = {
    f.__name__: f
    for f in (
        index_join_master, stable_id_or_null, section_zip, band_align, tiered_match, import_plan, redirect_chase, duplicate_songs,
        unique_title_track, translation_priority, two_hop_titles, assemble_cards, merge_evidence, merge_by_surface, clitic_fold,
        merge_sources, pooled_lemma_frequency, song_catalog, filtered_deck, song_filter, counts_by_grain, as_of_join,
    )
}

LINES = "lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
ORACLES = {
    "index_join_master": "SELECT l_orderkey, l_linenumber_pos AS pos, p_name, CASE WHEN l_quantity > 0 THEN l_quantity ELSE 1.0 END AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS l_linenumber_pos FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE p_size > 10",
    "stable_id_or_null": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN (SELECT s_name FROM supplier WHERE s_suppkey = l_suppkey * 2) ELSE (SELECT s_name FROM supplier WHERE s_suppkey = l_suppkey) END AS name FROM lineitem",
    "section_zip": """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, length(text) AS chars FROM conversations)
 SELECT a.conv_id, a.line, a.chars AS source_chars, b.chars AS target_chars FROM t a JOIN t b ON b.conv_id = a.conv_id + 1 AND a.line = b.line JOIN n x ON x.conv_id = a.conv_id JOIN n y ON y.conv_id = b.conv_id WHERE x.n = y.n""",
    "band_align": """WITH l AS (SELECT doc_id, unnest(range(len(s))) AS i, length(unnest(s)) AS len, len(s) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
 m AS (SELECT a.doc_id, a.i, b.i AS j, -abs(a.len - b.len) AS score FROM l a JOIN l b ON b.doc_id = a.doc_id + 1 AND abs(b.i - a.i * b.n // a.n) <= 3) SELECT * FROM m WHERE score >= -20 OR false QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY score DESC, j) = 1""",
    "tiered_match": """WITH t AS (SELECT s_suppkey, min(c_custkey) FILTER (s_suppkey = c_custkey) AS a, min(c_custkey) FILTER (abs(s_acctbal - c_acctbal) <= 10) AS b, min(c_custkey) AS c FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey)
 SELECT s_suppkey, coalesce(a, b, c) AS match, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'near' WHEN c IS NOT NULL THEN 'nation' END AS tier FROM t""",
    "import_plan": """WITH i AS (SELECT lower(p_name) AS s, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'no ' || p_name END AS e FROM part)
 SELECT p_partkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS plan FROM r LEFT JOIN i ON lower(e) = s""",
    "redirect_chase": """WITH RECURSIVE r AS (SELECT p_partkey AS word, p_partkey // 2 AS base FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 1), c AS (SELECT word, base, 1 AS hops FROM r UNION ALL SELECT c.word, r.base, hops + 1 FROM c JOIN r ON r.word = c.base WHERE hops < 5)
 SELECT word, base, min(hops) AS hops FROM c GROUP BY ALL""",
    "duplicate_songs": f"""WITH {LINES}, u AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)), f AS (SELECT doc_id, lower(line) AS line, min(line_no) AS pos FROM lines WHERE len(regexp_split_to_array(trim(line, ' '), ' +')) >= 3 AND doc_id IN (SELECT doc_id FROM u) GROUP BY ALL),
 s AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1), m AS (SELECT a.doc_id AS a, b.doc_id AS b, a.pos AS pa, b.pos - a.pos AS d FROM f a JOIN f b ON a.line = b.line AND a.doc_id < b.doc_id), i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, d ORDER BY pa) AS g FROM m),
 r AS (SELECT a, b, count(*) AS run FROM i GROUP BY a, b, d, g), p AS (SELECT a, b, sum(run) AS shared, max(run) AS run FROM r GROUP BY a, b), q AS (SELECT p.*, round(shared / least(x.n, y.n), 4) AS pct FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b)
 SELECT *, CASE WHEN pct >= 0.8 THEN 'near-duplicate' WHEN run >= 6 THEN 'shared verse' ELSE 'overlap' END AS label FROM q WHERE run >= 4 OR pct >= 0.3""",
    "unique_title_track": """SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')) = 1 THEN o_orderkey END AS track FROM orders""",
    "translation_priority": """SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('purchase', 'click', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, event_id DESC) = 1""",
    "two_hop_titles": "SELECT coalesce(r_name, n_name) AS title, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey GROUP BY 1",
    "assemble_cards": """WITH u AS (SELECT l_partkey, count(*) AS uses, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1), b AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) = 1)
 SELECT p_partkey AS l_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS price_rank, coalesce(uses, 0) AS uses, first_order, s_name FROM part LEFT JOIN u ON u.l_partkey = p_partkey LEFT JOIN b ON b.l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = b.l_suppkey""",
    "merge_evidence": """WITH r AS (SELECT p_name, p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT p_name, p_brand, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT p_name, count(DISTINCT l_orderkey) AS orders FROM r GROUP BY 1)
 SELECT p_name, sum(n) AS uses, string_agg(p_brand || ':' || n, ',' ORDER BY p_brand || ':' || n) AS variants, any_value(orders) AS orders FROM b JOIN o USING (p_name) GROUP BY p_name""",
    "merge_by_surface": """WITH r AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_brand) AS place, printf('%.2f', floor(100 * n / sum(n) OVER (PARTITION BY p_name)) / 100) AS share FROM r""",
    "clitic_fold": """WITH u AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) SELECT CASE WHEN p_size < 20 THEN p_partkey % 50 + 1 ELSE l_partkey END AS card, sum(uses) AS uses, count(*) AS forms FROM u LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "merge_sources": """WITH e AS (SELECT o_custkey, o_orderstatus, count(*) AS n, bool_or(o_totalprice > 300000) AS flag FROM orders GROUP BY ALL), c AS (SELECT o_custkey, max(n) AS n, bool_or(flag) AS flag FROM e GROUP BY 1) SELECT c_nationkey, c_mktsegment, sum(n) AS n, bool_or(flag) AS flag FROM c JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
    "pooled_lemma_frequency": f"WITH {LINES}, k AS (SELECT DISTINCT lower(trim(line, ' ')) AS k FROM lines WHERE trim(line, ' ') <> '') SELECT split_part(k, ' ', 1) AS lemma, count(*) AS lines FROM k GROUP BY 1",
    "song_catalog": """WITH e AS (SELECT o_custkey, l_partkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_partkey) AS place FROM e)
 SELECT o_custkey, count(*) AS cards, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY place) FILTER (place <= 10) AS first FROM r GROUP BY o_custkey""",
    "filtered_deck": """WITH u AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) SELECT CASE WHEN uses IS NULL THEN 'unused' WHEN uses < 15 THEN 'rare' WHEN p_size < 5 THEN 'small' WHEN p_retailprice < 950 THEN 'cheap' WHEN ends_with(p_brand, '5') THEN 'brand' ELSE 'shown' END AS reason, count(*) AS n FROM part LEFT JOIN u ON l_partkey = p_partkey GROUP BY 1""",
    "song_filter": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 40 = 0 AND o_orderstatus <> 'P')",
    "counts_by_grain": "SELECT source, lang, count(*) AS docs, sum(n_chars) AS chars, CAST(grouping(source, lang) AS BIGINT) AS grain FROM documents GROUP BY ROLLUP (source, lang)",
    "as_of_join": "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events WHERE event_type IN ('purchase', 'click') QUALIFY event_type = 'purchase'",
}
