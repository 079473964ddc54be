"""Queries on rules of senses, cards and transcriptions (FUN10-11, FLT09, FLT12, FLT24, FLT27, WIN22, SIM09, MOR02, AGG24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import lines as L
from lexspark.operators import sense_rules as R
from lexspark.session import dealt, table

POS = ("VERB", "NOUN", "ADJ", "ADV", "INTJ", "DET", "PRON", "NUM", "PHRASE", "ADP", "PROPN", "PART")


def _pos(column):
    return F.element_at(F.array(*[F.lit(p) for p in POS]), (F.pmod(column, F.lit(len(POS))) + 1).cast("int"))


def transcriptions(spark, sf_dir):
    """FUN10, FUN11: part names as transcriptions: a stress mark in front, a syllable mark behind three letters, two between words."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    phon = F.concat(F.lit("'"), F.substring("p_name", 1, 3), F.lit("-"), F.replace(F.expr("substring(p_name, 4)"), F.lit(" "), F.lit("--")), F.lit("-'x"))
    rows = p.select("p_name", phon.alias("phon"))
    return rows.select("p_name", R.strip_syllables(R.strip_stress(F.col("phon"))).alias("plain"), R.stress_pattern(F.col("phon")).alias("pattern"))


def sense_compatibility(spark, sf_dir):
    """FLT09: lines' suppliers as senses, their parts as examples' tags, an order's tags as those observed."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", _pos(F.col("l_suppkey")).alias("sense"), _pos(F.col("l_partkey")).alias("example"))
    seen = items.groupBy("l_orderkey").agg(F.collect_set("example").alias("observed"))
    rows = items.join(seen, "l_orderkey")
    s, e = F.col("sense"), F.col("example")
    return rows.groupBy("sense", "example").agg(
        F.count("*").alias("n"), F.count_if(R.fits_observed(s, F.col("observed"))).alias("observed"),
        F.count_if(R.fits_example(s, e)).alias("tagged"), F.count_if(R.fits_bridged(s, e)).alias("bridged"),
    )


def missing_entries(spark, sf_dir):
    """FLT12: parts without lines, by reason."""
    rows = table(spark, sf_dir, "part").withColumn("word", F.split("p_name", " ")[0])
    reason = R.unrenderable_reason(F.col("word"), F.array(F.lit("red"), F.lit("blue")), F.col("p_size") > 40, F.col("p_type").startswith("S"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def visible_cards(spark, sf_dir):
    """FLT24: parts shown by default: sizes and prices as flags, each order's tags as senses."""
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("uses"), F.collect_set(_pos(F.col("l_suppkey") * 5)).alias("senses")
    )
    p = table(spark, sf_dir, "part").join(uses, "p_partkey", "left")
    flags = [F.col("p_size") > 45, F.col("p_type").startswith("E"), F.lit(None).cast("boolean")]
    return p.where(R.visible(flags, F.col("senses"), F.col("p_retailprice") / 2000, F.lit(0.85), F.col("uses"))).select("p_partkey")


def untranslated_lines(spark, sf_dir):
    """FLT27: turns whose translation, for some the same text between marks, says nothing else."""
    turns = table(spark, sf_dir, "conversations")
    english = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, F.concat(F.lit("¡ "), "text", F.lit("!"))).otherwise(F.concat(F.lit("so "), "text"))
    return turns.where(R.untranslated(F.col("text"), english)).select("conv_id", "turn")


def proposal_evidence(spark, sf_dir):
    """AGG24: evidence of users' events: different values over 50, else days' ids of clicks, else all."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id", "event_type").agg(
        F.count_distinct(F.when(F.col("value") > 50, F.col("event_id"))).alias("o"), F.count_if(F.col("event_id") % 2 == 0).alias("i"), F.count("*").alias("x")
    )
    return rows.select("user_id", "event_type", R.evidence_count(F.col("o"), F.col("i"), F.col("x")).alias("evidence"))


def confidence_bands(spark, sf_dir):
    """WIN22: cuts for three shares of good documents by length; no length holds the last."""
    p = F.round(F.least(F.lit(10_000), F.length("text")) / 10_000, 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).join(table(spark, sf_dir, "labels"), "doc_id")
    return R.band_cuts(rows, "p", "quality", {"high": 0.9, "medium": 0.7, "never": 1.01})


def displayed_leaf(spark, sf_dir):
    """SIM09: an order's largest line, repaired within its return flag where its part is divisible by three."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_extendedprice")
    i = dealt(i, "l_orderkey")
    best = i.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("best"))
    rows = i.join(best, "l_orderkey").withColumn("bad", F.col("l_partkey") % 3 == 0).withColumn("picked", F.col("l_linenumber") == F.col("best"))
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_extendedprice", "bad", "picked")])
    return R.display_leaf(rows, "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "bad", "picked")


SHORT = {"na'": "nada", "pa'": "para"}


def elisions_in_context(spark, sf_dir):
    """MOR02: words of Spanish lines with some cut short, restored by their neighbours."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    cut = F.regexp_replace(F.lower("line"), r"(^| )(ve|vo|na|pa)[a-z]+", "$1$2'")
    rows = L.lines(docs).select(F.explode(R.ngram_tokens(T.tokens(cut), SHORT)).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        transcriptions, sense_compatibility, missing_entries, visible_cards, untranslated_lines, proposal_evidence, confidence_bands,
        displayed_leaf, elisions_in_context,
    )
}

TAGS = "['VERB','NOUN','ADJ','ADV','INTJ','DET','PRON','NUM','PHRASE','ADP','PROPN','PART']"
TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"
ORACLES = {
    "transcriptions": """WITH p AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, string_split('''' || left(p_name, 3) || '-' || replace(substr(p_name, 4), ' ', '--') || '-''x', '') AS c FROM p),
 f AS (SELECT p_name, list_reduce(list_prepend('n', c), lambda a, x: CASE WHEN right(a, 1) = 'n' THEN left(a, length(a) - 1) || CASE WHEN x = '''' THEN '1' ELSE '0' END WHEN x = '-' THEN a || 'n' ELSE a END) AS pattern FROM s)
 SELECT p_name, replace(p_name, ' ', '-') || 'x' AS plain, rtrim(pattern, 'n') AS pattern FROM f""",
    "sense_compatibility": f"""WITH i AS (SELECT l_orderkey, {TAGS}[l_suppkey % 12 + 1] AS s, {TAGS}[l_partkey % 12 + 1] AS e FROM lineitem), o AS (SELECT l_orderkey, list(DISTINCT e) AS seen FROM i GROUP BY 1),
 t AS (SELECT s, e, s IN ('PHRASE', 'CONTRACTION') AS free, s IN ('VERB', 'NOUN', 'ADJ', 'ADV', 'INTJ') AS st, e IN ('VERB', 'NOUN', 'ADJ', 'ADV', 'INTJ') AS et, list_contains(seen, s) AS met, len(list_filter(seen, lambda x: x NOT IN ('VERB', 'NOUN', 'ADJ', 'ADV', 'INTJ'))) > 0 AS un FROM i JOIN o USING (l_orderkey)),
 r AS (SELECT *, free OR s = e OR (NOT et AND NOT st) AS tagged FROM t)
 SELECT s AS sense, e AS example, count(*) AS n, count(*) FILTER (free OR met OR (NOT st AND un)) AS observed, count(*) FILTER (tagged) AS tagged, count(*) FILTER (CASE e WHEN 'DET' THEN free OR s IN ('ADJ', 'DET', 'PRON') WHEN 'PRON' THEN free OR s IN ('ADJ', 'DET', 'PRON')
 WHEN 'NUM' THEN free OR s IN ('ADJ', 'NOUN', 'DET') WHEN 'PART' THEN free OR s IN ('ADV', 'ADP', 'PRON') WHEN 'PROPN' THEN free OR s IN ('PROPN', 'NOUN') WHEN 'ADV' THEN free OR s IN ('ADV', 'PRON', 'ADJ') ELSE tagged END) AS bridged FROM r GROUP BY s, e""",
    "missing_entries": """SELECT CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN 'abbreviation' WHEN p_size > 40 THEN 'english loanword' WHEN p_type LIKE 'S%' THEN 'clitic form with no dictionary entry of its own' ELSE 'no sense menu' END AS reason, count(*) AS n FROM part GROUP BY 1""",
    "visible_cards": f"""SELECT p_partkey FROM part JOIN (SELECT l_partkey, count(*) AS uses, bool_or({TAGS}[l_suppkey * 5 % 12 + 1] <> 'PROPN') AS real FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size <= 45 AND p_type NOT LIKE 'E%' AND real AND p_retailprice / 2000 < 0.85 AND uses > 1""",
    "untranslated_lines": """SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 3 = 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')""",
    "proposal_evidence": """SELECT user_id, event_type, CASE WHEN count(*) FILTER (value > 50) > 0 THEN count(*) FILTER (value > 50) WHEN count(*) FILTER (event_id % 2 = 0) > 0 THEN count(*) FILTER (event_id % 2 = 0) ELSE count(*) END AS evidence FROM events GROUP BY ALL""",
    "confidence_bands": """WITH r AS (SELECT round(least(10000, length(text)) / 10000, 3) AS p, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT p, avg(quality) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS share FROM r)
 SELECT band, round(coalesce(min(p) FILTER (share >= t), max(p) + 1e-6), 4) AS cut FROM c, (VALUES ('high', 0.9), ('medium', 0.7), ('never', 1.01)) AS b(band, t) GROUP BY band""",
    "displayed_leaf": """WITH b AS (SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS best FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_extendedprice) AS l_extendedprice, bool_or(l_partkey % 3 = 0) AS bad FROM lineitem GROUP BY ALL),
 k AS (SELECT i.* FROM i JOIN b ON b.l_orderkey = i.l_orderkey AND best = l_linenumber),
 s AS (SELECT i.l_orderkey, i.l_linenumber FROM i JOIN k ON k.l_orderkey = i.l_orderkey AND k.l_returnflag = i.l_returnflag WHERE k.bad AND NOT i.bad QUALIFY row_number() OVER (PARTITION BY i.l_orderkey ORDER BY i.l_extendedprice DESC, i.l_linenumber) = 1)
 SELECT k.l_orderkey, coalesce(s.l_linenumber, k.l_linenumber) AS l_linenumber FROM k LEFT JOIN s USING (l_orderkey)""",
    "elisions_in_context": f"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS i, regexp_replace(lower(unnest(s)), '(^| )(ve|vo|na|pa)[a-z]+', '\\1\\2''', 'g') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE lang = 'es')),
 t AS (SELECT doc_id, i, regexp_extract_all(line, '{TOKEN}') AS t FROM l), u AS (SELECT doc_id, i, unnest(range(len(t))) AS k, unnest(t) AS w FROM t), c AS (SELECT w, lag(w) OVER o AS before, lead(w) OVER o AS behind FROM u WINDOW o AS (PARTITION BY doc_id, i ORDER BY k))
 SELECT CASE WHEN w = 've''' THEN CASE WHEN before IN ('una','otra','cada','tal','última','primera','esta','esa','la','qué','alguna','cualquier') THEN 'vez' ELSE 'ves' END WHEN w = 'vo''' THEN CASE WHEN behind = 'a' THEN 'voy' ELSE 'vos' END
 WHEN w = 'na''' THEN 'nada' WHEN w = 'pa''' THEN 'para' ELSE w END AS word, count(*) AS n FROM c GROUP BY 1""",
}
