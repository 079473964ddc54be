"""Queries on identity, claims, registries and set merges (IDN01-16, SET01-09, SNK06, JOI13, JOI18, AGG37)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.operators import identity as I
from lexspark.session import table


def surface_ids(spark, sf_dir):
    """IDN02: ids of part names, with the number of parts of each."""
    parts = table(spark, sf_dir, "part")
    return parts.groupBy("p_name").agg(F.count("*").alias("parts")).select(I.surface_id(F.col("p_name")).alias("id"), "p_name", "parts")


def example_ids(spark, sf_dir):
    """IDN03: ids of user turns with the assistant's next turn."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", I.example_id(F.col("text"), F.col("reply")).alias("example_id"))


def turn_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    own = W.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("reply", F.lead("text").over(own)).withColumn("next", F.lead("role").over(own))
    return pairs.where("role = 'user' and next = 'assistant' and text is not null and reply is not null")


def segment_ids(spark, sf_dir):
    """IDN04, IDN05: stable ids of lines; equal lines of a document carry an ordinal."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    ordinal = F.row_number().over(W.partitionBy("doc_id", F.md5(F.col("line").cast("binary"))).orderBy("line_no")) - 1
    key = F.md5(F.col("line").cast("binary"))
    return lines.withColumn("ordinal", ordinal).select("doc_id", "line_no", I.stable_id("segment", F.col("doc_id"), key, F.col("ordinal")).alias("id"))


def sense_ids(spark, sf_dir):
    """IDN06: the shortest free prefixes of the names and brands of each part type, in order of brand and name."""
    types = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name").distinct()
    content = F.concat_ws("|", "p_brand", "p_name")
    return I.least_prefix_id(types, ["p_type"], content, ["p_brand", "p_name"]).select("p_brand", "p_type", "p_name", "sense_id")


def knowledge_signature(spark, sf_dir):
    """IDN07: FNV-1a of part names."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", I.signature(F.col("p_name")).alias("signature"), I.signature(F.concat(F.lit("né-🙂-"), "p_name")).alias("wide"))


PRIORITY = {"purchase": 80, "click": 60, "signup": 50, "view": 20, "error": 0}


def _claims(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    priority = F.lit(None).cast("int")
    for kind, p in PRIORITY.items():
        priority = F.when(F.col("event_type") == kind, p).otherwise(priority)
    return events.select(
        F.col("event_id").alias("claim_id"), F.col("event_type").alias("layer"), F.col("user_id").alias("subject"),
        F.when(F.col("event_id") % 17 == 0, "retract").when(F.col("event_id") % 11 == 0, "abstain").otherwise("assert").alias("operation"),
        F.col("value"), (F.col("value") / 100).alias("confidence"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), priority.alias("priority"),
        F.when(F.col("event_id") % 17 == 0, F.array(F.col("event_id") - 1, F.col("event_id") - 2)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"),
    )


def resolve_claims(spark, sf_dir):
    """IDN08."""
    return I.resolve_claims(_claims(spark, sf_dir), 0.05).select("layer", "subject", "claim_id", "operation", "run_id")


def best_per_example(spark, sf_dir):
    """IDN09, FLT25: for each user and item the event of the highest priority of 50 or more, the first of equals."""
    rows = _claims(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), "props"), "claim_id")
    best = I.best_by_priority(rows.where("priority >= 50"), ["subject", "props"], "priority", "claim_id")
    return best.select("subject", "props", "claim_id", "layer")


def sense_provenance(spark, sf_dir):
    """IDN10: the kind of each item by tier, then the newest."""
    rows = _claims(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), "props", "ts"), "claim_id")
    return rows.groupBy("props").agg(F.max(F.struct("priority", "ts", "claim_id", "layer")).alias("m")).select("props", "m.layer", "m.claim_id")


def registry_resolve(spark, sf_dir):
    """IDN11: new cards (suppliers) to old ones (customers): the same number of name, else the only one of nation and rounded balance, else null."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal", -2).alias("bal"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("new"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", -2).alias("bal"))
    exact = new.join(old, (new.new * 10 == old.card) & (new.nation == old.nation)).groupBy("new").agg(F.min("card").alias("by_alias"))
    only = old.groupBy("nation", "bal").agg(F.count("*").alias("n"), F.min("card").alias("by_evidence")).where("n = 1")
    out = new.join(exact, "new", "left").join(only, ["nation", "bal"], "left")
    return out.select("new", F.coalesce("by_alias", "by_evidence").alias("card"))


def mutual_best(spark, sf_dir):
    """IDN12: customers and suppliers of one nation, best by each other's nearness of balance to a hundred."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("l"), F.col("c_acctbal").alias("a"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scope"), F.col("s_suppkey").alias("r"), F.col("s_acctbal").alias("b"))
    pairs = I.nearest_pairs(c, s).select(F.col("l").alias("c_custkey"), F.col("r").alias("s_suppkey"), (-F.round(F.abs(F.col("a") - F.col("b")), 0)).alias("near"))
    return I.mutual_best(pairs, "c_custkey", "s_suppkey", "near").select("c_custkey", "s_suppkey", "near")


def staleness_grid(spark, sf_dir):
    """IDN14: steps (event types of a user) against the newest one they depend on (the type before in the alphabet)."""
    stamps = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"), F.count("*").alias("version"))
    own = W.partitionBy("user_id").orderBy("event_type")
    grid = stamps.withColumn("needs", F.lag("at").over(own))
    status = F.when(F.col("version") < 2, "STALE").when(F.col("needs") > F.col("at"), "older").when(F.col("needs").isNull(), "stamp").otherwise("OK")
    return grid.select("user_id", "event_type", status.alias("status"))


def active_claims(spark, sf_dir):
    """JOI18, IDN15: claims all of whose references (the parts of an order) still have the active revision (odd size)."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey, "left").groupBy("l_orderkey").agg(
        F.bool_and(F.coalesce(F.col("p_size") > 3, F.lit(False))).alias("current")
    ).where("current").select("l_orderkey")


def append_only_store(spark, sf_dir):
    """SNK06, SET06: lines of even documents added to those of odd ones by content id."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    rows = lines.select(F.md5(F.col("line").cast("binary")).alias("id"), "doc_id")
    store = rows.where("doc_id % 2 = 1").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    return I.append_only(store, rows.where("doc_id % 2 = 0"), "id")


def changeset_full_outer(spark, sf_dir):
    """JOI13, SET01: what turns the orders' state of odd customers into that of even ones by priority and status."""
    orders = table(spark, sf_dir, "orders")
    side = lambda k: orders.where(F.col("o_custkey") % 2 == k).groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return I.changeset(side(0), side(1), ["o_orderpriority", "month"], ["n"])


def sheet_diff(spark, sf_dir):
    """SET02: rows added and removed between two versions of the parts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    old = parts.where("p_partkey % 10 <> 0")
    new = parts.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    added, gone = new.exceptAll(old), old.exceptAll(new)
    return added.withColumn("side", F.lit("added")).unionByName(gone.withColumn("side", F.lit("removed")))


def backfill_merge(spark, sf_dir):
    """SET03: evidence of one key joined, the first value that isn't null by input order."""
    events = table(spark, sf_dir, "events").withColumn("low", F.when(F.col("value") < 5, F.col("value")))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("event_id", c))).getField(c)
    return events.groupBy("user_id").agg(first("low").alias("low"), first("props").alias("props"), F.count("*").alias("n"))


def union_all_files(spark, sf_dir):
    """SET04: customers and suppliers one after the other, no row dropped."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return c.unionByName(s).groupBy("nation", "kind").agg(F.count("*").alias("n"))


def dedupe_senses(spark, sf_dir):
    """SET05, WIN32: the first place of each different line of a document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.groupBy("doc_id", F.md5(F.trim("line").cast("binary")).alias("key")).agg(F.min("line_no").alias("line_no")).select("doc_id", "line_no")


def first_per_lemma(spark, sf_dir):
    """SET08: the first part of each brand and size; parts of size 1 stand for themselves."""
    parts = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") == 1, F.concat(F.lit("__word__"), F.col("p_partkey"))).otherwise(F.concat_ws("|", "p_brand", "p_size"))
    return parts.groupBy(key.alias("lemma")).agg(F.min("p_partkey").alias("p_partkey"))


def carry_ids_by_content(spark, sf_dir):
    """SET09: the nth order of a customer and priority takes the nth old id of the same kind (those before 1996)."""
    orders = table(spark, sf_dir, "orders").withColumn("old", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    nth = F.row_number().over(W.partitionBy("o_custkey", "o_orderpriority", "old").orderBy("o_orderkey"))
    rows = orders.withColumn("nth", nth)
    a = rows.where("not old").select("o_orderkey", "o_custkey", "o_orderpriority", "nth")
    b = rows.where("old").select(F.col("o_orderkey").alias("carried"), "o_custkey", "o_orderpriority", "nth")
    return a.join(b, ["o_custkey", "o_orderpriority", "nth"], "left").select("o_orderkey", "carried")


def rebuild_diff(spark, sf_dir):
    """AGG37: words of odd and even documents: lost, recovered, or kept with another count."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[ \n]+")).alias("w")).where("w <> ''")
    live = words.where("doc_id % 2 = 0").groupBy("w").agg(F.count("*").alias("a"))
    new = words.where("doc_id % 2 = 1").groupBy("w").agg(F.count("*").alias("b"))
    both = live.join(new, "w", "full_outer")
    kind = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "recovered").when(F.col("a") != F.col("b"), "migrated").otherwise("same")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        surface_ids, example_ids, segment_ids, sense_ids, knowledge_signature, resolve_claims, best_per_example, sense_provenance,
        registry_resolve, mutual_best, staleness_grid, active_claims, append_only_store, changeset_full_outer, sheet_diff, backfill_merge,
        union_all_files, dedupe_senses, first_per_lemma, carry_ids_by_content, rebuild_diff,
    )
}

LINES = "lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
CLAIMS = """claims AS (SELECT event_id AS claim_id, event_type AS layer, user_id AS subject, CASE WHEN event_id % 17 = 0 THEN 'retract' WHEN event_id % 11 = 0 THEN 'abstain' ELSE 'assert' END AS operation,
  value / 100 AS confidence, strftime(ts, '%Y-%m-%d') AS run_id, CASE event_type WHEN 'purchase' THEN 80 WHEN 'click' THEN 60 WHEN 'signup' THEN 50 WHEN 'view' THEN 20 WHEN 'error' THEN 0 END AS priority, props, ts FROM events)"""
ORACLES = {
    "surface_ids": "SELECT left(md5('surface/v2:' || p_name), 8) AS id, p_name, count(*) AS parts FROM part GROUP BY p_name",
    "example_ids": """WITH p AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, left(sha256(lower(trim(text, ' ')) || chr(0) || lower(trim(reply, ' '))), 12) AS example_id FROM p WHERE role = 'user' AND next = 'assistant' AND text IS NOT NULL AND reply IS NOT NULL""",
    "segment_ids": f"""WITH {LINES}, o AS (SELECT doc_id, line_no, md5(line) AS key, row_number() OVER (PARTITION BY doc_id, md5(line) ORDER BY line_no) - 1 AS ordinal FROM lines)
 SELECT doc_id, line_no, 'segment:' || left(sha256('["' || doc_id || '","' || key || '","' || ordinal || '"]'), 24) AS id FROM o""",
    "sense_ids": """WITH t AS (SELECT DISTINCT p_brand, p_type, p_name, md5(p_brand || '|' || p_name) AS h FROM part),
 l3 AS (SELECT *, row_number() OVER (PARTITION BY p_type, left(h, 3) ORDER BY p_brand, p_name) AS k FROM t),
 l4 AS (SELECT *, row_number() OVER (PARTITION BY p_type, left(h, 4) ORDER BY p_brand, p_name) AS k FROM (SELECT p_brand, p_type, p_name, h FROM l3 WHERE k > 1)),
 l5 AS (SELECT *, row_number() OVER (PARTITION BY p_type, left(h, 5) ORDER BY p_brand, p_name) AS k FROM (SELECT p_brand, p_type, p_name, h FROM l4 WHERE k > 1)),
 l6 AS (SELECT *, row_number() OVER (PARTITION BY p_type, left(h, 6) ORDER BY p_brand, p_name) AS k FROM (SELECT p_brand, p_type, p_name, h FROM l5 WHERE k > 1)),
 l7 AS (SELECT *, row_number() OVER (PARTITION BY p_type, left(h, 7) ORDER BY p_brand, p_name) AS k FROM (SELECT p_brand, p_type, p_name, h FROM l6 WHERE k > 1)) SELECT p_brand, p_type, p_name, left(h, 3) AS sense_id FROM l3 WHERE k = 1 UNION ALL SELECT p_brand, p_type, p_name, left(h, 4) AS sense_id FROM l4 WHERE k = 1 UNION ALL SELECT p_brand, p_type, p_name, left(h, 5) AS sense_id FROM l5 WHERE k = 1 UNION ALL SELECT p_brand, p_type, p_name, left(h, 6) AS sense_id FROM l6 WHERE k = 1 UNION ALL SELECT p_brand, p_type, p_name, left(h, 7) AS sense_id FROM l7 WHERE k = 1""",
    "knowledge_signature": """WITH n AS (SELECT DISTINCT p_name FROM part), f AS (SELECT p_name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS a,
 list_reduce([2166136261::BIGINT, 110, 233, 45, 55357, 56898, 45] || list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS b FROM n) SELECT p_name, printf('%08x', a) AS signature, printf('%08x', b) AS wide FROM f""",
    "resolve_claims": f"""WITH {CLAIMS}, gone AS (SELECT claim_id - 1 AS id FROM claims WHERE operation = 'retract' UNION SELECT claim_id - 2 FROM claims WHERE operation = 'retract')
 SELECT layer, subject, claim_id, operation, run_id FROM claims WHERE operation <> 'retract' AND confidence >= 0.05 AND claim_id NOT IN (SELECT id FROM gone)
 QUALIFY row_number() OVER (PARTITION BY layer, subject ORDER BY priority DESC, run_id DESC, claim_id DESC) = 1""",
    "best_per_example": f"WITH {CLAIMS} SELECT subject, props, claim_id, layer FROM claims WHERE priority >= 50 QUALIFY row_number() OVER (PARTITION BY subject, props ORDER BY priority DESC, claim_id) = 1",
    "sense_provenance": f"WITH {CLAIMS} SELECT props, layer, claim_id FROM claims QUALIFY row_number() OVER (PARTITION BY props ORDER BY priority DESC, ts DESC, claim_id DESC) = 1",
    "registry_resolve": """WITH o AS (SELECT c_custkey AS card, c_nationkey AS nation, round(c_acctbal, -2) AS bal FROM customer), n AS (SELECT s_suppkey AS new, s_nationkey AS nation, round(s_acctbal, -2) AS bal FROM supplier)
 SELECT new, coalesce((SELECT min(card) FROM o WHERE o.card = n.new * 10 AND o.nation = n.nation), (SELECT min(card) FROM o WHERE o.nation = n.nation AND o.bal = n.bal HAVING count(*) = 1)) AS card FROM n""",
    "mutual_best": """WITH p AS (SELECT c_custkey, s_suppkey, -round(abs(c_acctbal - s_acctbal), 0) AS near FROM customer JOIN supplier ON c_nationkey = s_nationkey),
 t AS (SELECT *, max(near) OVER (PARTITION BY c_custkey) AS l, max(near) OVER (PARTITION BY s_suppkey) AS r FROM p), u AS (SELECT *, count(*) FILTER (near = l) OVER (PARTITION BY c_custkey) AS ln, count(*) FILTER (near = r) OVER (PARTITION BY s_suppkey) AS rn FROM t)
 SELECT c_custkey, s_suppkey, near FROM u WHERE near = l AND near = r AND ln = 1 AND rn = 1""",
    "staleness_grid": """WITH s AS (SELECT user_id, event_type, max(ts) AS stamp, count(*) AS version FROM events GROUP BY ALL), g AS (SELECT *, lag(stamp) OVER (PARTITION BY user_id ORDER BY event_type) AS needs FROM s)
 SELECT user_id, event_type, CASE WHEN version < 2 THEN 'STALE' WHEN needs > stamp THEN 'older' WHEN needs IS NULL THEN 'stamp' ELSE 'OK' END AS status FROM g""",
    "active_claims": "SELECT l_orderkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING bool_and(coalesce(p_size > 3, false))",
    "append_only_store": f"WITH {LINES}, r AS (SELECT md5(line) AS id, doc_id FROM lines) SELECT id, coalesce(min(doc_id) FILTER (doc_id % 2 = 1), min(doc_id)) AS doc_id FROM r GROUP BY id",
    "changeset_full_outer": """WITH g AS (SELECT o_custkey % 2 AS k, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_orderpriority, month, max(n) FILTER (k = 0) AS a, max(n) FILTER (k = 1) AS b FROM g GROUP BY ALL)
 SELECT o_orderpriority, month, CASE WHEN b IS NULL THEN 'insert' WHEN a IS NULL THEN 'delete' ELSE 'update' END AS change FROM p WHERE a IS DISTINCT FROM b""",
    "sheet_diff": """WITH o AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey, p_brand, p_size + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS p_size FROM part WHERE p_partkey % 7 <> 0)
 SELECT *, 'added' AS side FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)""",
    "backfill_merge": "SELECT user_id, arg_min(value, event_id) FILTER (value < 5) AS low, arg_min(props, event_id) AS props, count(*) AS n FROM events GROUP BY user_id",
    "union_all_files": "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL",
    "dedupe_senses": f"WITH {LINES} SELECT doc_id, min(line_no) AS line_no FROM lines GROUP BY doc_id, trim(line, ' ')",
    "first_per_lemma": "SELECT CASE WHEN p_size = 1 THEN '__word__' || p_partkey ELSE p_brand || '|' || p_size END AS lemma, min(p_partkey) AS p_partkey FROM part GROUP BY 1",
    "carry_ids_by_content": """WITH r AS (SELECT *, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, old ORDER BY o_orderkey) AS nth FROM r)
 SELECT a.o_orderkey, b.o_orderkey AS carried FROM n a LEFT JOIN n b ON b.old AND a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.nth = b.nth WHERE NOT a.old""",
    "rebuild_diff": """WITH w AS (SELECT doc_id % 2 AS k, unnest(regexp_split_to_array(lower(text), '[ \n]+')) AS w FROM documents), c AS (SELECT w, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b FROM w WHERE w <> '' GROUP BY w)
 SELECT CASE WHEN b = 0 THEN 'lost' WHEN a = 0 THEN 'recovered' WHEN a <> b THEN 'migrated' ELSE 'same' END AS kind, count(*) AS n FROM c GROUP BY 1""",
}
