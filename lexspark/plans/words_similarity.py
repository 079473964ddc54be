"""Queries on word forms and similarity (MOR01-10, PRJ09-14, AGG08, AGG09, WIN19, SIM01-20, FUN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import lines as L
from lexspark.operators import morphology as M
from lexspark.operators import retirement
from lexspark.operators import similarity as S
from lexspark.plans.text_lines import FOLD, NGRAMS, PMI, TOKEN
from lexspark.session import parts, table


def _words(spark, sf_dir, lang):
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == lang)
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()


def derivation_base(spark, sf_dir):
    """MOR05."""
    words = _words(spark, sf_dir, "es")
    return M.derivations(words, words)


def plural_redirect(spark, sf_dir):
    """MOR06."""
    return M.plural_redirects(_words(spark, sf_dir, "es"))


def clitic_strip(spark, sf_dir):
    """MOR03, MOR04."""
    words = _words(spark, sf_dir, "es")
    return M.strip_clitics(words, words)


def elision_restore(spark, sf_dir):
    """MOR01, the unique tier alone: sung words in -ao, -io and -a' that are one known word when d, r or s is put back.

    Sung words: the Spanish ones, and those in -ado, -ido, -r and -s without their d or last letter. elision_chain has all tiers.
    """
    known = _words(spark, sf_dir, "es")
    sung = (("ado$", "ao"), ("ido$", "io"), ("[rs]$", "'"))
    words = known.select(F.explode(F.array("word", *[F.regexp_replace("word", a, b) for a, b in sung])).alias("word")).distinct()
    forms = F.array_compact(F.array(
        F.when(F.col("word").endswith("ao"), F.regexp_replace("word", "ao$", "ado")), F.when(F.col("word").endswith("ío"), F.regexp_replace("word", "ío$", "ido")),
        F.when(F.col("word").endswith("io"), F.regexp_replace("word", "io$", "ido")), F.when(F.col("word").endswith("'"), F.regexp_replace("word", "'$", "r")),
        F.when(F.col("word").endswith("'"), F.regexp_replace("word", "'$", "s")),
    ))
    each = words.select("word", F.explode(forms).alias("full")).join(known.select(F.col("word").alias("full")), "full", "left_semi")
    return each.groupBy("word").agg(F.count("*").alias("n"), F.min("full").alias("full")).select("word", F.when(F.col("n") == 1, F.col("full")).alias("full"))


def stem_en(spark, sf_dir):
    """MOR09."""
    words = _words(spark, sf_dir, "en").select(M.stem_en(F.col("word")).alias("stem"))
    return words.groupBy("stem").agg(F.count("*").alias("forms"))


def cognate_rules(spark, sf_dir):
    """SIM01, by rule alone, without a lexicon."""
    return M.cognates(_words(spark, sf_dir, "es"), _words(spark, sf_dir, "en"))


LABELS = ("Noun", "masculine noun", "pronoun", "possessive pronoun", "transitive verb", "adverb", "adverbial phrase", "proper noun", "definite article", "roman numeral", "Letter", "", "idiom")


def pos_normalize(spark, sf_dir):
    """PRJ14: labels made of part types and of each label's place in a list, over all parts."""
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("p_partkey", F.lit(len(LABELS))) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, F.concat_ws(" ", F.lower("p_type"), label)).otherwise(label).alias("label"))
    return rows.groupBy("label", M.normalize_pos(F.col("label")).alias("pos")).agg(F.count("*").alias("n"))


def translation_normalize(spark, sf_dir):
    """PRJ12: user turns' first lines."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", M.normalize_translation(F.col("text")).alias("gloss"))


def gloss_clean(spark, sf_dir):
    """PRJ09-11."""
    lines = L.lines(table(spark, sf_dir, "documents")).where("line like '%, %'")
    return lines.select("doc_id", "line_no", M.clean_gloss(F.col("line")).alias("gloss"))


def production_plural(spark, sf_dir):
    """MOR10."""
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", M.pluralize(F.col("p_name")).alias("plural"))


SLOT = ("la", "le", "les", "lo", "los", "me", "nos", "se", "te", "it", "that", "this")


def slot_families(spark, sf_dir):
    """AGG08: three- and four-word phrases with one pronoun, pooled over it: four uses or more and two variants."""
    docs = table(spark, sf_dir, "documents")
    toks = F.split("ngram", " ")
    rows = L.ngrams(docs, (3, 4)).where(F.size(F.filter(toks, lambda t: t.isin(*SLOT))) == 1)
    key = F.array_join(F.transform(toks, lambda t: F.when(t.isin(*SLOT), "[PRON]").otherwise(t)), " ")
    # phrases of a family are dealt to one part, of which there are as many as the bytes read ask for
    each = rows.select("n", key.alias("family"), "ngram").repartition(parts(docs, 2), "n", "family").groupBy("n", "family", "ngram").agg(F.count("*").alias("c"))
    pooled = each.groupBy("n", "family").agg(F.sum("c").alias("count"), F.count("*").alias("variants"))
    return pooled.where("count >= 4 and variants >= 2")


def family_line_union(spark, sf_dir):
    """AGG09: for each family the number of different lines of its variants: a union, not a sum."""
    each = L.ngrams(table(spark, sf_dir, "documents"), (3,))
    holds = F.size(F.filter(F.split("ngram", " "), lambda t: t.isin(*SLOT)))
    key = F.array_join(F.transform(F.split("ngram", " "), lambda t: F.when(t.isin(*SLOT), "[PRON]").otherwise(t)), " ")
    rows = each.where(holds == 1).select(key.alias("family"), "doc_id", "line").distinct()
    return rows.groupBy("family").agg(F.count("*").alias("lines")).where("lines >= 3")


def overlap_dedupe(spark, sf_dir):
    """WIN19: phrases (from a PMI of 25 on) not contained in a longer kept one."""
    return L.overlap_dedupe(L.pmi_phrases(table(spark, sf_dir, "documents"), 25.0)).select("n", "ngram")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def prototype_mean(spark, sf_dir):
    """SIM16: prototypes of labels with three vectors or more; their first and largest values."""
    p = S.prototypes(_vectors(spark, sf_dir), ["label"], "embedding", 3)
    return p.select("label", "n", F.round(F.col("prototype")[0], 5).alias("first"), F.round(F.array_max("prototype"), 5).alias("most"))


def _scores(spark, sf_dir):
    """Each vector against each label's prototype: the labels are a menu of fixed size."""
    vectors = _vectors(spark, sf_dir)
    menu = S.prototypes(vectors, ["label"], "embedding", 3).select(F.col("label").alias("sense"), "prototype")
    scored = vectors.join(F.broadcast(menu), F.lit(True))
    return scored.select("vec_id", "label", "sense", F.round(S.dot(F.col("embedding"), F.col("prototype")), 6).alias("score"))


def cosine_argmax(spark, sf_dir):
    """SIM04: the best label of each vector, kept where it has 5 % of the vectors."""
    best = S.first_best(_scores(spark, sf_dir), ["vec_id"], F.col("score"), [F.col("sense")])
    n = best.agg(F.count("*").alias("n"))
    large = best.groupBy("sense").agg(F.count("*").alias("k")).join(F.broadcast(n), F.lit(True)).where("k >= 0.05 * n").select("sense")
    return best.join(F.broadcast(large), "sense", "left_semi").select("vec_id", "sense", F.round("score", 4).alias("score"))


def menu_prior_score(spark, sf_dir):
    """SIM06: cosine and a prior that halves along the menu: the best by both."""
    scored = _scores(spark, sf_dir).withColumn("total", F.round(F.col("score") + 0.02 * F.pow(F.lit(0.5), F.col("sense")), 6))
    return S.first_best(scored, ["vec_id"], F.col("total"), [F.col("sense")]).select("vec_id", "sense")


def tuple_class_gap(spark, sf_dir):
    """SIM07: best score of the picked group (labels modulo 3) less that of the others."""
    groups = _scores(spark, sf_dir).withColumn("g", F.col("sense") % 3).groupBy("vec_id", "g").agg(F.max("score").alias("s"))
    best = groups.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("g")).alias("m"))).alias("b"), F.sort_array(F.collect_list("s"), False).alias("all"))
    return best.select("vec_id", (-F.col("b.m")).alias("g"), F.round(F.col("all")[0] - F.col("all")[1], 6).alias("gap"))


def keyword_overlap(spark, sf_dir):
    """SIM05: for each part name the other one that shares most words, one at least; of equals the first."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    words = names.select("name", F.explode(F.split("name", " ")).alias("w")).distinct()
    other = words.select(F.col("name").alias("other"), "w")
    met = words.join(other, "w").where("name <> other").groupBy("name", "other").agg(F.count("*").alias("shared"))
    return S.first_best(met, ["name"], F.col("shared"), [F.col("other")]).select("name", "other", "shared")


def unique_cue_route(spark, sf_dir):
    """SIM12: words that one brand's part names alone have within a type and size; a part with cues of one brand is routed."""
    parts = table(spark, sf_dir, "part").withColumn("scope", F.concat_ws("/", "p_type", "p_size"))
    rows = parts.select("p_partkey", "scope", "p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    cues = S.cue_owners(rows, "scope", "w", "p_brand").withColumnRenamed("p_brand", "owner")
    met = rows.join(cues, ["scope", "w"]).groupBy("p_partkey").agg(F.count_distinct("owner").alias("k"), F.min("owner").alias("owner"))
    return met.select("p_partkey", F.when(F.col("k") == 1, F.col("owner")).alias("owner"))


def pivot_longest_cue(spark, sf_dir):
    """SIM11: the longest word of each part name, none where two are as long."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    top = words.groupBy("p_partkey", F.length("w").alias("n")).agg(F.count("*").alias("k"), F.min("w").alias("w"))
    best = top.groupBy("p_partkey").agg(F.max(F.struct("n", "k", "w")).alias("b"))
    return best.select("p_partkey", F.when(F.col("b.k") == 1, F.col("b.w")).alias("cue"))


def jaccard_names(spark, sf_dir):
    """SIM02, its links only: pairs of different part names of a type with a word Jaccard of 0.3 or more, by shared words."""
    names = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    words = names.select("p_type", "p_name", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    n = words.groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    words = words.join(n, ["p_type", "p_name"])
    other = words.select("p_type", F.col("p_name").alias("other"), "w", F.col("n").alias("m"))
    met = words.join(other, ["p_type", "w"]).where("p_name < other").groupBy("p_type", "p_name", "other", "n", "m").agg(F.count("*").alias("k"))
    jaccard = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    return met.select("p_type", "p_name", "other", F.round(jaccard, 6).alias("jaccard")).where("jaccard >= 0.3")


def retire_near_senses(spark, sf_dir):
    """SIM17, SIM20: within a label, vectors retired by an earlier kept one at a cosine of 0.7 or more."""
    return retirement.retire(_vectors(spark, sf_dir), "label", "vec_id", "embedding", "vec_id", 0.7)


def alignment_percentiles(spark, sf_dir):
    """SIM19: inner products of each vector with the next one, and their 10th, 50th and 90th of a hundred."""
    v = _vectors(spark, sf_dir)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    scores = v.join(other, "vec_id").select(F.round(S.dot(F.col("embedding"), F.col("next")), 4).alias("s"))
    return scores.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY s)").alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)], F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        derivation_base, plural_redirect, clitic_strip, elision_restore, stem_en, cognate_rules, pos_normalize, translation_normalize,
        gloss_clean, production_plural, slot_families, family_line_union, overlap_dedupe, prototype_mean, cosine_argmax, menu_prior_score,
        tuple_class_gap, keyword_overlap, unique_cue_route, pivot_longest_cue, jaccard_names, retire_near_senses, alignment_percentiles,
    )
}

WORDS = f"(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents WHERE lang = '%s')"
RULES = ", ".join(f"({i * 100 + j}, '{s}', {n}, '{e}')" for i, (s, n, es) in enumerate(M.DERIVATIONS) for j, e in enumerate(es))
PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in M.COGNATES)
CLITICS = ", ".join([f"({i}, '{c}', '{c}')" for i, c in enumerate(M.ENCLITICS)] + [
    f"({100 + 10 * i + j}, '{a}{b}', '{a}+{b}')" for i, a in enumerate(("me", "te", "se", "nos", "os")) for j, b in enumerate(("los", "las", "lo", "la", "le", "les"))
])
STEM = """CASE WHEN word LIKE '_%ying' THEN left(word, length(word) - 4) || 'y' WHEN word LIKE '___%ies' OR word LIKE '___%ied' THEN left(word, length(word) - 3) || 'y' WHEN word LIKE '___%ing' THEN left(word, length(word) - 3)
 WHEN word LIKE '____%tion' THEN left(word, length(word) - 4) || 'te' WHEN word LIKE '____%ness' OR word LIKE '____%ment' THEN left(word, length(word) - 4) WHEN word LIKE '____%ally' THEN left(word, length(word) - 4) || 'al'
 WHEN word LIKE '__%ly' OR word LIKE '__%ed' OR word LIKE '__%er' OR word LIKE '__%es' THEN left(word, length(word) - 2) WHEN word LIKE '_%s' THEN left(word, length(word) - 1) ELSE word END"""
POS = "CASE " + " ".join(f"WHEN lower(label) = '{k}' THEN '{v}'" for k, v in M.POS_EXACT.items()) + " " + " ".join(f"WHEN contains(lower(label), '{k}') THEN '{v}'" for k, v in M.POS_TESTS) + " ELSE 'X' END"
SLOTS = ", ".join(f"'{s}'" for s in SLOT)
FAMILY = f"array_to_string(list_transform(string_split(ngram, ' '), lambda t: CASE WHEN t IN ({SLOTS}) THEN '[PRON]' ELSE t END), ' ')"
ONE = f"len(list_filter(string_split(ngram, ' '), lambda t: t IN ({SLOTS}))) = 1"
PROTO = """m AS (SELECT label, d, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL HAVING count(*) >= 3),
 k AS (SELECT label, sqrt(sum(x * x)) AS norm, any_value(n) AS n FROM m GROUP BY label), p AS (SELECT label, any_value(k.n) AS n, list(x / norm ORDER BY d) AS v FROM m JOIN k USING (label) GROUP BY label)"""
SCORES = f"WITH {PROTO}, s AS (SELECT vec_id, e.label, p.label AS sense, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: embedding[i]::DOUBLE * v[i])), 6) AS score FROM embeddings e, p)"
ORACLES = {
    "derivation_base": f"""WITH w AS {WORDS % 'es'}, r AS (SELECT * FROM (VALUES {RULES}) AS t(o, suffix, n, ending)), s AS (SELECT word, o, ending, left(word, length(word) - length(suffix)) AS stem FROM w JOIN r ON ends_with(word, suffix) AND length(word) - length(suffix) >= n),
 c AS (SELECT word, o, stem || ending AS base FROM s UNION SELECT word, o, translate(stem, 'áéíóú', 'aeiou') || ending FROM s UNION SELECT word, o, regexp_replace(translate(stem, 'áéíóú', 'aeiou'), 'qu$', 'c') || ending FROM s WHERE left(ending, 1) IN ('o', 'a')
  UNION SELECT word, o, regexp_replace(translate(stem, 'áéíóú', 'aeiou'), 'gu$', 'g') || ending FROM s WHERE left(ending, 1) IN ('o', 'a'))
 SELECT word, arg_min(base, (o, base)) AS base FROM c WHERE base <> word AND base IN (SELECT word FROM w) GROUP BY word""",
    "plural_redirect": f"""WITH w AS {WORDS % 'es'}, f AS (SELECT word, {FOLD % 'word'} AS f FROM w), s AS (SELECT word AS singular, CASE WHEN ends_with(f, 'z') THEN regexp_replace(f, 'z$', 'ces') WHEN regexp_matches(f, '[aeiou]$') THEN f || 's' ELSE f || 'es' END AS f FROM f)
 SELECT f.word AS plural, arg_min(singular, (length(singular), singular)) AS singular FROM f JOIN s USING (f) WHERE f.word <> singular GROUP BY 1""",
    "clitic_strip": f"""WITH w AS {WORDS % 'es'}, r AS (SELECT * FROM (VALUES {CLITICS}) AS t(o, tail, clitics)), c AS (SELECT word, o, translate(left(word, length(word) - length(tail)), 'áéíóú', 'aeiou') AS host, clitics FROM w JOIN r ON ends_with(word, tail) AND length(word) - length(tail) >= 3)
 SELECT word, arg_min(host, o) AS host, arg_min(clitics, o) AS clitics FROM c WHERE host IN (SELECT word FROM w) GROUP BY word""",
    "elision_restore": f"""WITH k AS {WORDS % 'es'}, w AS (SELECT DISTINCT unnest([word, regexp_replace(word, 'ado$', 'ao'), regexp_replace(word, 'ido$', 'io'), regexp_replace(word, '[rs]$', '''')]) AS word FROM k), c AS (SELECT word, unnest([CASE WHEN ends_with(word, 'ao') THEN regexp_replace(word, 'ao$', 'ado') END, CASE WHEN ends_with(word, 'ío') THEN regexp_replace(word, 'ío$', 'ido') END,
 CASE WHEN ends_with(word, 'io') THEN regexp_replace(word, 'io$', 'ido') END, CASE WHEN ends_with(word, '''') THEN regexp_replace(word, '''$', 'r') END, CASE WHEN ends_with(word, '''') THEN regexp_replace(word, '''$', 's') END]) AS full_form FROM w)
 SELECT word, CASE WHEN count(*) = 1 THEN min(full_form) END AS "full" FROM c WHERE full_form IN (SELECT word FROM k) GROUP BY word""",
    "stem_en": f"WITH w AS {WORDS % 'en'} SELECT {STEM} AS stem, count(*) AS forms FROM w GROUP BY 1",
    "cognate_rules": f"""WITH s AS (SELECT word AS es, regexp_replace({FOLD % 'word'}, 's$', '') AS s FROM {WORDS % 'es'} WHERE length(word) >= 4), r AS (SELECT * FROM (VALUES {PAIRS}) AS t(a, b)),
 m AS (SELECT es, s AS e FROM s UNION SELECT es, left(s, length(s) - length(a)) || b FROM s JOIN r ON ends_with(s, a) AND length(s) > length(a)), n AS (SELECT word AS en, {FOLD % 'word'} AS e FROM {WORDS % 'en'} WHERE length(word) >= 4)
 SELECT DISTINCT es, en FROM m JOIN (SELECT en, e FROM n UNION SELECT en, regexp_replace(e, 's$', '') FROM n) USING (e)""",
    "pos_normalize": f"""WITH l AS (SELECT CASE WHEN p_size > 25 THEN lower(p_type) || ' ' || label ELSE label END AS label FROM (SELECT *, [{', '.join(repr(x) for x in LABELS)}][p_partkey % {len(LABELS)} + 1] AS label FROM part))
 SELECT label, {POS.replace("lower(label)", "lower(trim(label, ' '))")} AS pos, count(*) AS n FROM l GROUP BY ALL""",
    "translation_normalize": """SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text, ' ')), '^to ', ''), '^(i|you|he|she|it|we|they) ', ''), ' (me|you|him|her|it|us|them)$', ''), '^([a-z]{3,})s( |$)', '\\1\\2') AS gloss FROM conversations WHERE text IS NOT NULL""",
    "production_plural": "SELECT p_name, CASE WHEN regexp_matches(p_name, '[^aeiou]y$') THEN regexp_replace(p_name, 'y$', 'ies') WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' ELSE p_name || 's' END AS plural FROM (SELECT DISTINCT p_name FROM part)",
    "slot_families": f"WITH {NGRAMS % (3, '3, 4')} SELECT n, {FAMILY} AS family, sum(count) AS count, count(*) AS variants FROM counts WHERE {ONE} GROUP BY 1, 2 HAVING sum(count) >= 4 AND count(*) >= 2",
    "family_line_union": f"WITH {NGRAMS % (3, '3')} SELECT {FAMILY} AS family, count(DISTINCT (doc_id, line_key)) AS lines FROM grams WHERE {ONE} GROUP BY 1 HAVING count(DISTINCT (doc_id, line_key)) >= 3",
    "overlap_dedupe": f"""WITH q AS ({PMI % '25.0'}), k5 AS (SELECT n, ngram FROM q WHERE n = 5), k4 AS (SELECT * FROM k5 UNION ALL SELECT n, ngram FROM q WHERE n = 4 AND NOT EXISTS (SELECT 1 FROM k5 WHERE contains(k5.ngram, q.ngram))),
 k3 AS (SELECT * FROM k4 UNION ALL SELECT n, ngram FROM q WHERE n = 3 AND NOT EXISTS (SELECT 1 FROM k4 WHERE contains(k4.ngram, q.ngram))) SELECT * FROM k3 UNION ALL SELECT n, ngram FROM q WHERE n = 2 AND NOT EXISTS (SELECT 1 FROM k3 WHERE contains(k3.ngram, q.ngram))""",
    "prototype_mean": f"WITH {PROTO} SELECT label, n, round(v[1], 5) AS first, round(list_max(v), 5) AS most FROM p",
    "cosine_argmax": f"{SCORES}, b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, sense) = 1) SELECT vec_id, sense, round(score, 4) AS score FROM b QUALIFY count(*) OVER (PARTITION BY sense) >= 0.05 * count(*) OVER ()",
    "menu_prior_score": f"{SCORES} SELECT vec_id, sense FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score + 0.02 * power(0.5, sense), 6) DESC, sense) = 1",
    "tuple_class_gap": f"{SCORES}, g AS (SELECT vec_id, sense % 3 AS g, max(score) AS s FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, g) AS k FROM g) SELECT a.vec_id, a.g, round(a.s - b.s, 6) AS gap FROM r a LEFT JOIN r b ON a.vec_id = b.vec_id AND b.k = 2 WHERE a.k = 1",
    "keyword_overlap": """WITH w AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS w FROM (SELECT DISTINCT lower(p_name) AS name FROM part)), m AS (SELECT a.name, b.name AS other, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.name <> b.name GROUP BY ALL)
 SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY shared DESC, other) = 1""",
    "unique_cue_route": """WITH w AS (SELECT DISTINCT p_partkey, p_type, p_size, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part), c AS (SELECT p_type, p_size, w, min(p_brand) AS owner FROM w GROUP BY ALL HAVING count(DISTINCT p_brand) = 1)
 SELECT p_partkey, CASE WHEN count(DISTINCT owner) = 1 THEN min(owner) END AS owner FROM w JOIN c USING (p_type, p_size, w) GROUP BY p_partkey""",
    "pivot_longest_cue": """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), t AS (SELECT *, max(length(w)) OVER (PARTITION BY p_partkey) AS m FROM w) SELECT p_partkey, CASE WHEN count(*) = 1 THEN min(w) END AS cue FROM t WHERE length(w) = m GROUP BY p_partkey""",
    "jaccard_names": """WITH w AS (SELECT DISTINCT p_type, p_name, unnest(string_split(p_name, ' ')) AS w FROM part), n AS (SELECT p_type, p_name, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT a.p_type, a.p_name, b.p_name AS other, count(*) AS k FROM w a JOIN w b ON a.p_type = b.p_type AND a.w = b.w AND a.p_name < b.p_name GROUP BY ALL)
 SELECT m.p_type, m.p_name, other, round(k / (x.n + y.n - k), 6) AS jaccard FROM m JOIN n x ON x.p_type = m.p_type AND x.p_name = m.p_name JOIN n y ON y.p_type = m.p_type AND y.p_name = other WHERE round(k / (x.n + y.n - k), 6) >= 0.3""",
    "alignment_percentiles": """WITH s AS (SELECT round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 4) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
 SELECT quantile_disc(s, 0.1) AS p10, quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.9) AS p90, count(*) AS n FROM s""",
}
