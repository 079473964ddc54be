"""Queries that scan text (TOK01, TOK02, TOK05, TOK08, PRJ05-07, FLT02, FLT05, FLT19, IDN01, FUN01-03, UDF05, UDF08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import lines as L
from lexspark.operators import scanning as S
from lexspark.session import table


def _short(spark, sf_dir):
    return L.lines(table(spark, sf_dir, "documents"))


def source_tokens(spark, sf_dir):
    """TOK05, UDF08: a digest of each line's tokens with their spans."""
    toks = S.source_tokens(_short(spark, sf_dir).select("doc_id", "line_no", "line"), "line")
    return toks.groupBy("doc_id", "line_no").agg(
        F.count("*").alias("n"), F.sum("start").alias("starts"), F.max("end").alias("last"), F.max(F.struct("ordinal", "surface")).getField("surface").alias("surface")
    )


def surface_pairs(spark, sf_dir):
    """TOK01, TOK02: canonical words with the number of ways they are shown."""
    rows = L.lines(table(spark, sf_dir, "documents")).select(F.explode(S.tokens_with_surfaces("line")).alias("t"))
    return rows.groupBy("t.canonical").agg(F.count("*").alias("n"), F.count_distinct("t.surface").alias("surfaces"))


def subtitle_clean(spark, sf_dir):
    """PRJ06: what is left of lines; junk is dropped."""
    rows = L.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", S.clean_subtitle(F.col("line")).alias("clean"))
    return rows.where("clean is not null").select("doc_id", "line_no", F.md5(F.col("clean").cast("binary")).alias("clean"))


def identity_forms(spark, sf_dir):
    """PRJ07: lines by their identity form."""
    rows = L.lines(table(spark, sf_dir, "documents")).select(S.identity_normal(F.col("line")).alias("form"))
    return rows.groupBy(F.md5(F.col("form").cast("binary")).alias("form")).agg(F.count("*").alias("n"))


def mwe_substrings(spark, sf_dir):
    """TOK08: short strings counted as plain substrings in every tenth document."""
    patterns = ["tion of", "and the", "the th", "ment de", "en un", "ción de", "of the of"]
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 = 0")
    return S.substring_counts(docs, "text", patterns)


def split_gates(spark, sf_dir):
    """FLT05: lines that are broken (dropped), a matter of taste (kept, with the reason) or clean."""
    rows = L.lines(table(spark, sf_dir, "documents")).withColumn("toks", T.tokens(F.col("line")))
    broken = F.when(F.length(F.trim("line")) == 0, "empty").when(F.size("toks") < 2, "no words").when(F.col("line").rlike("[|#$%&*]{2}"), "noise")
    taste = F.when(F.size("toks") > 18, "long").when(F.col("line").rlike("[!?]{2}"), "loud").when(~T.good_context(F.col("toks")), "thin")
    rows = rows.withColumn("broken", broken).where("broken is null").withColumn("taste", taste)
    return rows.groupBy(F.coalesce("taste", F.lit("clean")).alias("taste")).agg(F.count("*").alias("n"))


def english_guards(spark, sf_dir):
    """FLT02, FLT19: lines of good context half of whose words are plain ASCII without q, by language."""
    rows = L.tokenised(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    plain = F.expr("size(filter(toks, t -> t rlike '^[a-pr-z]+$'))")
    return rows.where(T.good_context(F.col("toks")) & (plain * 2 >= F.size("toks"))).groupBy("lang").agg(F.count("*").alias("n"))


def stable_ids(spark, sf_dir):
    """IDN01: six digits for words and languages."""
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return S.stable_ids(docs, F.concat_ws("|", "word", "lang")).select("word", "lang", "id")


def scalar_functions(spark, sf_dir):
    """FUN01-03: strings, hashes and both ways to round, over parts."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.reverse("p_name").alias("reversed"), F.lpad(F.hex("p_partkey"), 6, "0").alias("hex"), F.initcap(F.lower("p_type")).alias("title"),
        F.substring(F.sha1(F.col("p_name").cast("binary")), 1, 8).alias("sha"),
        F.round(F.col("p_size") / 4, 0).cast("long").alias("half_up"), F.bround(F.col("p_size") / 4, 0).cast("long").alias("half_even"),
        F.round(F.log2(F.col("p_size") + 1), 6).alias("bits"), F.greatest(F.lit(5), F.least(F.lit(20), F.col("p_size"))).alias("clamped"),
    )


def registered_method(spark, sf_dir):
    """UDF05: a registered rule's answers on labelled documents."""
    methods = S.Registry()
    methods.register("longest", lambda d: d.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("sense"), F.lit(1.0).alias("confidence")))
    out = methods.run("longest", table(spark, sf_dir, "documents"))
    return out.join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).groupBy("sense").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


QUERIES = {
    f.__name__: f
    for f in (source_tokens, surface_pairs, subtitle_clean, identity_forms, mwe_substrings, split_gates, english_guards, stable_ids, scalar_functions, registered_method)
}

LINES = "lines AS (SELECT doc_id, lang, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"
TOKEN = r"[\p{L}]+(?:''[\p{L}]+)*''?"
GOOD = "(len(toks) >= 5 AND NOT (len(toks) >= 6 AND len(list_distinct(toks)) <= 2))"
SOURCE_TOKEN = r"[''’‘ʼ`]?[\p{L}\p{M}]+(?:[''’‘ʼ`][\p{L}\p{M}]+)*"
JUNK = " OR ".join(f"regexp_matches(line, '{p}')" for p in S.SUBTITLE_JUNK)
ORACLES = {
    "source_tokens": f"""WITH {LINES}, m AS (SELECT doc_id, line_no, regexp_extract_all(line, '{SOURCE_TOKEN}') AS t, regexp_split_to_array(line, '{SOURCE_TOKEN}') AS g FROM lines),
 u AS (SELECT doc_id, line_no, unnest(range(1, len(t) + 1)) AS k, t, g FROM m), e AS (SELECT doc_id, line_no, k, t[k] AS surface, sum(length(g[k]) + length(t[k])) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS stop FROM u)
 SELECT doc_id, line_no, count(*) AS n, sum(stop - length(surface)) AS starts, max(stop) AS last, arg_max(surface, k) AS surface FROM e GROUP BY ALL""",
    "surface_pairs": f"WITH {LINES}, s AS (SELECT unnest(regexp_extract_all(line, '{TOKEN}')) AS s FROM lines) SELECT lower(s) AS canonical, count(*) AS n, count(DISTINCT s) AS surfaces FROM s GROUP BY 1",
    "subtitle_clean": f"WITH {LINES} SELECT doc_id, line_no, md5(trim(regexp_replace(trim(line, ' '), '^[-–—] *', ''), ' ')) AS clean FROM lines WHERE NOT ({JUNK})",
    "identity_forms": f"WITH {LINES} SELECT md5(replace(trim(regexp_replace(lower(translate(nfc_normalize(line), '’‘ʼ`´', '''''''''''')), '\\s+', ' ', 'g'), ' '), 'ß', 'ss')) AS form, count(*) AS n FROM lines GROUP BY 1",
    "mwe_substrings": """WITH p AS (SELECT unnest(['tion of', 'and the', 'the th', 'ment de', 'en un', 'ción de', 'of the of']) AS pattern), d AS (SELECT text FROM documents WHERE doc_id % 10 = 0)
 SELECT pattern, sum(n) AS n FROM (SELECT pattern, len(list_filter(range(1, length(text) - length(pattern) + 2), lambda i: text[i:i + length(pattern) - 1] = pattern)) AS n FROM p, d WHERE contains(text, pattern)) GROUP BY pattern""",
    "split_gates": f"""WITH {LINES}, t AS (SELECT *, regexp_extract_all(lower(line), '{TOKEN}') AS toks FROM lines), k AS (SELECT * FROM t WHERE length(trim(line, ' ')) > 0 AND len(toks) >= 2 AND NOT regexp_matches(line, '[|#$%&*]{{2}}'))
 SELECT CASE WHEN len(toks) > 18 THEN 'long' WHEN regexp_matches(line, '[!?]{{2}}') THEN 'loud' WHEN NOT {GOOD} THEN 'thin' ELSE 'clean' END AS taste, count(*) AS n FROM k GROUP BY 1""",
    "english_guards": f"WITH {LINES}, t AS (SELECT lang, regexp_extract_all(lower(line), '{TOKEN}') AS toks FROM lines) SELECT lang, count(*) AS n FROM t WHERE {GOOD} AND len(list_filter(toks, lambda t: regexp_matches(t, '^[a-pr-z]+$'))) * 2 >= len(toks) GROUP BY lang",
    "stable_ids": f"""WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents), m AS (SELECT *, md5(word || '|' || lang) AS m FROM w)
 SELECT word, lang, substr(m, row_number() OVER (PARTITION BY left(m, 6) ORDER BY word || '|' || lang), 6) AS id FROM m""",
    "scalar_functions": """SELECT p_partkey, reverse(p_name) AS reversed, lpad(hex(p_partkey), 6, '0') AS hex, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title, left(sha1(p_name), 8) AS sha,
 CAST(round(p_size / 4, 0) AS BIGINT) AS half_up, CAST(round_even(p_size / 4, 0) AS BIGINT) AS half_even, round(log2(p_size + 1), 6) AS bits, greatest(5, least(20, p_size)) AS clamped FROM part""",
    "registered_method": "SELECT CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS sense, count(*) AS n, sum(quality) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1",
}
