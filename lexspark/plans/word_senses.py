"""Queries on headwords, verb forms, cognates and groups of glosses (FLT10, FLT11, SIM01, SIM15, MOR07, PRJ15, SIM02, SIM03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import cognates as C
from lexspark.operators import gloss_groups as G
from lexspark.operators import headwords as H
from lexspark.operators import lines as L
from lexspark.plans.text_lines import FOLD, TOKEN
from lexspark.session import cut, table

# person, number, mood, tense, pronoun and ending of the forms that the queries give each verb
PARADIGM = (
    ("1", "s", "indicativo", "presente", "yo", "o"), ("2", "s", "indicativo", "presente", "tú", "as"), ("2", "s", "imperativo", "negativo", "", "es"),
    ("", "", "gerundio", "gerundio", "", "ando"), ("", "", "participo", "participo", "", "ado"), ("3", "s", "subjuntivo", "pretérito-imperfecto", "él", "ara"),
    ("3", "s", "subjuntivo", "pretérito-imperfecto", "él", "ase"), ("3", "p", "subjuntivo", "pretérito-imperfecto", "ellos", "asen"),
    ("3", "p", "subjuntivo", "pretérito-imperfecto-1", "ellos", "aran"),
)


def _spanish(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct().select(T.fold_accents(F.col("word")).alias("surface")).distinct()


def _menu(spark, sf_dir):
    """Surfaces with made-up headwords, forms of verbs and known words."""
    words = cut(_spanish(spark, sf_dir), "folded-words")
    s = F.col("surface")
    chop = lambda n: F.expr(f"substring(surface, 1, length(surface) - {n})")
    heads = F.array(s, chop(1), F.concat(chop(2), F.lit("o")), chop(2), F.concat(s, F.lit("r")), F.concat(chop(3), F.lit("arse")), F.lit(None))
    menu = words.select(s, F.explode(F.array_distinct(heads)).alias("headword"), F.when(F.length(s) % 11 == 0, " Inflection").alias("relation"))
    reverse = words.where("surface like '%o'").select(s.alias("form"), F.concat(chop(1), F.lit("ar")).alias("lemma"))
    reverse = reverse.union(words.where("surface like '%a'").select(s.alias("form"), F.concat(s, F.lit("r")).alias("lemma")))
    cache = words.where("length(surface) % 3 < 2").select(s, F.when(F.length(s) % 7 == 0, F.array(F.substring(s, 1, 3))).alias("pointers"))
    return menu, cache, reverse, words.where("length(surface) % 2 = 0").select(s.alias("form"))


def headword_vetting(spark, sf_dir):
    """FLT10: each surface's headwords with the rule that keeps them."""
    menu, cache, reverse, forms = _menu(spark, sf_dir)
    return H.vet_headwords(menu.join(cache, "surface", "left"), reverse, forms).select("surface", "headword", "reason")


def menu_purge(spark, sf_dir):
    """FLT11: what vetting takes out of the menu."""
    return H.purge_menu(*_menu(spark, sf_dir))[1].select("surface", "headword")


def reflexive_gate(spark, sf_dir):
    """SIM15: the first word behind a pronoun of each Spanish line (without one: its first word), in all three modes; persons by ending."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    rows = L.lines(docs).select("doc_id", "line_no", F.regexp_extract_all(T.fold_accents(F.col("line")), F.lit("[a-z0-9]+"), F.lit(0)).alias("toks"))
    first = F.array_position(F.transform("toks", lambda t: t.isin(*H.CLITICS)), F.lit(True))
    behind = F.filter(F.slice("toks", (first + 1).cast("int"), F.size("toks")), lambda t: ~t.isin(*H.CLITICS))
    rows = rows.withColumn("target", F.get(behind, F.lit(0))).where("target is not null")
    t = F.col("target")
    persons = F.when(t.endswith("o"), F.array(F.lit("1"))).when(t.endswith("s"), F.array(F.lit("2"))).when(F.length(t) <= 9, F.array(F.lit("3")))
    modes = {"se_only": "se-only", "permissive": "permissive", "dative_aware": "dative-aware"}
    return rows.select("doc_id", "line_no", "target", *[H.reflexive(t, F.col("toks"), m, persons).alias(n) for n, m in modes.items()])


def _paradigms(spark, sf_dir):
    names = ("person", "number", "mood", "tense", "pronoun", "ending")
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(n) for n, v in zip(names, cell)]) for i, cell in enumerate(PARADIGM)])
    verbs = _spanish(spark, sf_dir).where("surface like '%ar'").select(F.col("surface").alias("lemma"), F.explode(cells).alias("c")).select("lemma", "c.*")
    said = F.concat(F.expr("substring(lemma, 1, length(lemma) - 2)"), "ending")
    form = F.concat(F.when(F.col("pronoun") != "", F.concat(F.initcap("pronoun"), F.lit(" "))).otherwise(""), F.when(F.col("mood") == "imperativo", "no ").otherwise(""), said)
    return verbs.withColumn("pronoun", F.initcap("pronoun")).withColumn("form", form)


def reverse_conjugations(spark, sf_dir):
    """MOR07: forms of all verbs in -ar of the documents back to their lemmas."""
    return H.reverse_lookup(_paradigms(spark, sf_dir))


def conjugation_fallbacks(spark, sf_dir):
    """MOR07: tables of verbs of even length from their forms."""
    p = _paradigms(spark, sf_dir)
    label = F.concat("person", "number")
    morphology = p.select("ord", "lemma", "mood", "tense", label.alias("person"), H.bare_form(F.col("form"), F.col("pronoun")).alias("form"))
    return H.fallback_tables(morphology, p.where("length(lemma) % 2 = 0").select("lemma"))


def name_senses(spark, sf_dir):
    """PRJ15: parts as senses with tags: which are names, and what a meaning carries on."""
    p = table(spark, sf_dir, "part")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), F.col("p_partkey") % len(values))
    kind = F.when(F.col("p_size") % 9 == 0, "proper_noun").when(F.col("p_size") % 3 == 0, "slang").when(F.col("p_size") % 3 == 1, "")
    gloss = F.concat(pick("Proper-noun ", "the name of ", "names of ", "a proper name: ", "a name, ", "", "improper noun ", "properly "), "p_name")
    sense = F.struct(kind.alias("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("construction"))
    meaning = H.carry_tags(F.struct(F.lit("old").alias("type"), F.lit(None).cast("string").alias("construction")), sense)
    pos = pick("NOUN", "propn", "Proper_Noun ", None, "VERB", "PROPERNOUN", "noun")
    rows = p.select("p_partkey", H.is_name_sense(kind, pos, gloss).alias("is_name"), meaning.alias("m"))
    return rows.select("p_partkey", "is_name", "m.type", "m.construction")


def cognate_scores(spark, sf_dir):
    """SIM01: Spanish words against English-looking spellings of themselves. SQL has no ratio of matching blocks; tested on a fixture."""
    docs = table(spark, sf_dir, "documents").where("lang = 'es'")
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    plain = T.fold_accents(F.col("word"))
    chop = lambda n: F.substring(plain, F.lit(1), F.length(plain) - n)
    glosses = F.array(F.replace(plain, F.lit("f"), F.lit("ph")), F.concat(chop(1), F.lit("e")), F.replace(plain, F.lit("t"), F.lit("th")), F.concat(chop(4), F.lit("tion")), F.concat(chop(3), F.lit("ics")))
    return C.cognate_scores(words.select("word", F.explode(F.array_distinct(glosses)).alias("gloss")), "word", "gloss")


def _order_senses(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.lower("p_type").alias("kind"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey").join(parts, "l_partkey")


def proposal_clusters(spark, sf_dir):
    """SIM03: an order's lines of one flag as proposals for one word, their parts as glosses."""
    rows = _order_senses(spark, sf_dir).withColumn("gloss", F.concat("p_name", F.lit("s of the "), "kind"))
    return G.cluster_proposals(rows, ["l_orderkey", "l_returnflag"], "gloss", ["l_linenumber", "l_partkey"], "l_linenumber")


def sense_merges(spark, sf_dir):
    """SIM02: the same lines as senses; some glosses have stop words only."""
    bare = F.when(F.col("l_partkey") % 17 == 0, "to").when(F.col("l_partkey") % 17 == 1, "With")
    gloss = F.coalesce(bare, F.concat("p_name", F.lit(", "), "kind", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" ("), "l_returnflag", F.lit(")"))).otherwise("")))
    return G.merge_senses(_order_senses(spark, sf_dir).withColumn("gloss", gloss), ["l_orderkey", "l_returnflag"], "gloss", "l_linenumber")


QUERIES = {
    f.__name__: f
    for f in (
        headword_vetting, menu_purge, reflexive_gate, reverse_conjugations, conjugation_fallbacks, name_senses, cognate_scores, proposal_clusters,
        sense_merges,
    )
}


def _names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


WORDS = f"w AS (SELECT DISTINCT {FOLD % 'word'} AS s FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents WHERE lang = 'es'))"
STEM = "(CASE WHEN length({x}) > 2 AND right({x}, 1) IN ('a', 'o') THEN left({x}, length({x}) - 1) ELSE {x} END)"
NUMBER = "(CASE WHEN ends_with({x}, 'es') AND length({x}) > 3 THEN left({x}, length({x}) - 2) WHEN ends_with({x}, 's') AND length({x}) > 2 THEN left({x}, length({x}) - 1) ELSE {x} END)"
CLUSTERS = (
    "['selos', 'selas', 'melos', 'melas', 'noslo', 'nosla', 'telos', 'telas', 'selo', 'sela', 'melo', 'mela', 'telo', 'tela', 'nos', 'los', 'las', 'les', 'me', 'te', 'se', 'lo', 'la', 'le', 'os']"
)
VETTED = f"""{WORDS}, m AS (SELECT DISTINCT s, unnest([s, left(s, greatest(length(s) - 1, 0)), left(s, greatest(length(s) - 2, 0)) || 'o', left(s, greatest(length(s) - 2, 0)), s || 'r', left(s, greatest(length(s) - 3, 0)) || 'arse', NULL]) AS headword FROM w),
 p AS (SELECT s, headword, coalesce(headword, '') AS h, CASE WHEN ends_with(headword, 'se') THEN left(headword, length(headword) - 2) ELSE coalesce(headword, '') END AS base FROM m),
 rev AS (SELECT s AS form, left(s, length(s) - 1) || 'ar' AS lemma FROM w WHERE s LIKE '%o' UNION SELECT s, s || 'r' FROM w WHERE s LIKE '%a'),
 v1 AS (SELECT s, unnest(list_append(list_transform(list_filter({CLUSTERS}, lambda c: ends_with(f, c) AND length(f) > length(c) + 1), lambda c: left(f, length(f) - length(c))), f)) AS v FROM (SELECT s, replace(s, '''', '') AS f FROM w)),
 v2 AS (SELECT s, v FROM v1 UNION SELECT s, v || 's' FROM v1),
 v3 AS (SELECT s, v FROM v2 UNION SELECT s, left(v, length(v) - 1) FROM v2 WHERE v LIKE '%s' UNION SELECT s, left(v, length(v) - 2) || 'o' FROM v2 WHERE v LIKE '%as' OR v LIKE '%os' UNION SELECT s, left(v, length(v) - 1) || 'o' FROM v2 WHERE v LIKE '%a'),
 t AS (SELECT DISTINCT p.s, p.h FROM p JOIN v3 USING (s) JOIN rev ON form = v AND lemma IN (h, base)), known AS (SELECT DISTINCT form FROM rev),
 vetted AS (SELECT p.s AS surface, headword, CASE WHEN trim(p.h) = '' THEN 'empty' WHEN p.s = p.h THEN 'self' WHEN length(p.s) % 11 = 0 THEN 'flag'
 WHEN length(p.s) % 7 = 0 AND length(p.s) % 3 < 2 AND (starts_with(p.h, left(p.s, 3)) OR starts_with(left(p.s, 3), p.h)) THEN 'pointer' WHEN t.s IS NOT NULL THEN 'table'
 WHEN (p.h IN (SELECT form FROM known) OR base IN (SELECT form FROM known) OR regexp_matches(p.h, '[aei]r$') OR regexp_matches(base, '[aei]r$'))
  AND len(list_filter({CLUSTERS}, lambda c: ends_with(p.s, c) AND length(p.s) > length(c) + 1 AND left(p.s, length(p.s) - length(c)) IN (p.h, base))) > 0 THEN 'enclitic'
 WHEN length(p.h) % 2 = 0 AND p.h IN (SELECT s FROM w) AND ((p.h LIKE '%z' AND p.s = left(p.h, length(p.h) - 1) || 'ces') OR (p.s LIKE '%z' AND p.h = left(p.s, length(p.s) - 1) || 'ces') OR p.s IN (p.h || 's', p.h || 'es') OR p.h IN (p.s || 's', p.s || 'es')
  OR (length({STEM.format(x='sn')}) >= 3 AND {STEM.format(x='sn')} = {STEM.format(x='hn')} AND p.s <> p.h)) THEN 'variant' END AS reason
 FROM (SELECT *, {NUMBER.format(x='s')} AS sn, {NUMBER.format(x='h')} AS hn FROM p) p LEFT JOIN t ON t.s = p.s AND t.h = p.h)"""
CELLS = ", ".join(f"({i}, " + ", ".join(f"'{v}'" for v in c) + ")" for i, c in enumerate(PARADIGM))
FORMS = f"""{WORDS}, f AS (SELECT ord, s AS lemma, mood, tense, person, number, left(s, length(s) - 2) || ending AS form FROM w, (VALUES {CELLS}) AS c(ord, person, number, mood, tense, pronoun, ending) WHERE s LIKE '%ar')"""
SHOWN = """CASE WHEN mood = 'indicativo' AND tense = 'presente' THEN 'Presente' WHEN mood = 'indicativo' AND tense = 'pretérito-perfecto-simple' THEN 'Pretérito' WHEN mood = 'indicativo' AND tense = 'pretérito-imperfecto' THEN 'Imperfecto'
 WHEN mood = 'indicativo' AND tense = 'futuro' THEN 'Futuro' WHEN mood = 'condicional' AND tense = 'presente' THEN 'Condicional' WHEN mood = 'subjuntivo' AND tense = 'presente' THEN 'Subj. Presente'
 WHEN mood = 'subjuntivo' AND tense IN ('pretérito-imperfecto-1', 'pretérito-imperfecto') THEN 'Subj. Imperfecto' WHEN mood = 'gerundio' THEN 'gerund' WHEN mood = 'participo' THEN 'past_participle' END"""
CLITIC = "('me', 'te', 'se', 'nos', 'os', 'lo', 'la', 'le', 'los', 'las', 'les')"
SENSES = "SELECT l_orderkey AS k, l_returnflag AS p, l_linenumber AS it, l_partkey, p_name, lower(p_type) AS kind FROM lineitem JOIN part ON p_partkey = l_partkey"
SHARE = "(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END)"
MEETS = SHARE.format(a="x.t", b="r.t") + " >= 0.25"
STOPS = """('a', 'an', 'the', 'to', 'of', 'in', 'on', 'at', 'for', 'is', 'it', 'be', 'as', 'or', 'by', 'and', 'not', 'with', 'from', 'that', 'this', 'but', 'are', 'was', 'were', 'been', 'has', 'have', 'had', 'do', 'does', 'did',
 'will', 'would', 'can', 'could', 'may', 'might', 'shall', 'should', 'up', 'out', 'if', 'no', 'so', 'into', 'over', 'also', 'its', 'one')"""
PROPOSAL = "('a', 'an', 'and', 'for', 'of', 'or', 'slang', 'the', 'to', 'people', 'person', 'situation', 'term', 'word')"
ORACLES = {
    "headword_vetting": f"WITH {VETTED} SELECT * FROM vetted",
    "menu_purge": f"WITH {VETTED} SELECT surface, headword FROM vetted WHERE reason IS NULL AND length(surface) % 3 < 2",
    "reflexive_gate": f"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE lang = 'es')),
 t AS (SELECT doc_id, line_no, regexp_extract_all({FOLD % 'line'}, '[a-z0-9]+') AS toks FROM l), u AS (SELECT doc_id, line_no, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok FROM t), c AS (SELECT doc_id, line_no, coalesce(min(i) FILTER (tok IN {CLITIC}), 0) AS i FROM u GROUP BY ALL),
 g AS (SELECT u.doc_id, u.line_no, arg_min(tok, u.i) AS target FROM u JOIN c ON c.doc_id = u.doc_id AND c.line_no = u.line_no AND u.i > c.i WHERE tok NOT IN {CLITIC} GROUP BY ALL),
 a AS (SELECT g.*, (SELECT min(i) FROM u WHERE u.doc_id = g.doc_id AND u.line_no = g.line_no AND tok = target) AS at FROM g),
 s AS (SELECT a.*, coalesce((SELECT max(i) FROM u WHERE u.doc_id = a.doc_id AND u.line_no = a.line_no AND i < a.at AND tok NOT IN {CLITIC}), 0) AS stop FROM a),
 k AS (SELECT s.*, coalesce((SELECT list(tok) FROM u WHERE u.doc_id = s.doc_id AND u.line_no = s.line_no AND i < s.at AND i > s.stop), []) AS cl FROM s),
 q AS (SELECT *, CASE WHEN target LIKE '%o' THEN '1' WHEN target LIKE '%s' THEN '2' WHEN length(target) <= 9 THEN '3' END AS person FROM k)
 SELECT doc_id, line_no, target, CASE WHEN list_contains(cl, 'se') THEN true WHEN len(cl) = 0 THEN false END AS se_only, list_has_any(cl, ['me', 'te', 'se', 'nos', 'os']) AS permissive,
 CASE WHEN list_contains(cl, 'se') THEN true WHEN len(cl) = 0 OR list_has_any(cl, ['le', 'les', 'lo', 'la', 'los', 'las']) THEN false WHEN person IS NULL THEN NULL ELSE (person = '1' AND list_has_any(cl, ['me', 'nos'])) OR (person = '2' AND list_has_any(cl, ['te', 'os'])) END AS dative_aware FROM q""",
    "reverse_conjugations": f"WITH {FORMS} SELECT form, lemma, mood, tense, person || number AS person FROM f",
    "conjugation_fallbacks": f"""WITH {FORMS} SELECT lemma, {SHOWN} AS slot, person || number AS person, arg_min(form, ord) AS form FROM f WHERE length(lemma) % 2 = 0 AND mood <> 'imperativo' GROUP BY ALL""",
    "name_senses": """WITH s AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_size % 9 = 0 THEN 'proper_noun' WHEN p_size % 3 = 0 THEN 'slang' WHEN p_size % 3 = 1 THEN '' END AS kind,
 ['Proper-noun ', 'the name of ', 'names of ', 'a proper name: ', 'a name, ', '', 'improper noun ', 'properly '][p_partkey % 8 + 1] || p_name AS gloss, ['NOUN', 'propn', 'Proper_Noun ', NULL, 'VERB', 'PROPERNOUN', 'noun'][p_partkey % 7 + 1] AS pos FROM part)
 SELECT p_partkey, coalesce(kind = 'proper_noun', false) OR coalesce(upper(trim(pos)) IN ('PROPN', 'PROPER_NOUN', 'PROPERNOUN'), false) OR regexp_matches(lower(gloss), '^(a |an |the )?proper[ -]*(noun|name)\\b|^(the )?name of\\b') AS is_name,
 CASE WHEN kind <> '' THEN kind ELSE 'old' END AS type, CASE WHEN p_size % 2 = 0 THEN p_type END AS construction FROM s""",
    "proposal_clusters": f"""WITH RECURSIVE s AS (SELECT *, p_name || 's of the ' || kind AS g FROM ({SENSES})),
 r AS (SELECT k, p, it, list_transform(list_filter(regexp_extract_all(lower(g), '[a-z0-9]+'), lambda x: x NOT IN {PROPOSAL}), lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 4 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END) AS t,
  row_number() OVER (PARTITION BY k, p ORDER BY length(g), lower(g), it, l_partkey) AS i FROM s),
 f AS (SELECT DISTINCT k, p, 0::BIGINT AS i, []::STRUCT(t VARCHAR[], ids BIGINT[])[] AS c FROM r
  UNION ALL SELECT k, p, i, CASE WHEN spot IS NULL THEN list_append(c, {{'t': t, 'ids': [it::BIGINT]}}) ELSE list_concat(c[1:spot - 1], [{{'t': list_concat(flatten(list_transform(m, lambda x: x.t)), t), 'ids': list_append(flatten(list_transform(m, lambda x: x.ids)), it::BIGINT)}}], rest) END
  FROM (SELECT f.k, f.p, r.i, f.c, r.t, r.it, list_filter(f.c, lambda x: {MEETS}) AS m, nullif(list_position(list_transform(f.c, lambda x: {MEETS}), true), 0) AS spot, list_filter(f.c[coalesce(nullif(list_position(list_transform(f.c, lambda x: {MEETS}), true), 0), 1):], lambda x: NOT ({MEETS})) AS rest FROM f JOIN r ON r.k = f.k AND r.p = f.p AND r.i = f.i + 1)),
 z AS (SELECT k, p, unnest(range(1, len(c) + 1)) AS cluster, unnest(c) AS c FROM (SELECT k, p, arg_max(c, i) AS c FROM f GROUP BY ALL))
 SELECT k AS l_orderkey, p AS l_returnflag, cluster, unnest(c.ids) AS l_linenumber FROM z""",
    "sense_merges": f"""WITH RECURSIVE s AS (SELECT k, p, it, CASE l_partkey % 17 WHEN 0 THEN 'to' WHEN 1 THEN 'With' ELSE p_name || ', ' || kind || CASE WHEN it % 3 = 0 THEN ' (' || p || ')' ELSE '' END END AS g FROM ({SENSES})),
 r AS (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY it, g) AS i, list_distinct(list_filter(regexp_extract_all(lower(string_split(g, '(')[1]), '[a-z]+'), lambda x: x NOT IN {STOPS} AND length(x) > 1)) AS t FROM s),
 e AS (SELECT a.k, a.p, a.i, b.i AS j FROM r a JOIN r b ON a.k = b.k AND a.p = b.p WHERE CASE WHEN len(a.t) + len(b.t) = 0 THEN lower(a.g) = lower(b.g) ELSE {SHARE.format(a="a.t", b="b.t")} >= 0.3 END),
 reach AS (SELECT k, p, i, i AS j FROM r UNION SELECT reach.k, reach.p, reach.i, e.j FROM reach JOIN e ON e.k = reach.k AND e.p = reach.p AND e.i = reach.j),
 c AS (SELECT r.k, r.p, r.i, r.it, r.g, comp FROM r JOIN (SELECT k, p, i, min(j) AS comp FROM reach GROUP BY ALL) USING (k, p, i)),
 b AS (SELECT *, row_number() OVER (PARTITION BY k, p, comp ORDER BY length(g) DESC, i) AS place, count(*) OVER (PARTITION BY k, p, comp) AS senses FROM c),
 o AS (SELECT k, p, comp, i, unnest(range(len(x))) AS n, trim(unnest(x)) AS term FROM (SELECT *, string_split(g, ',') AS x FROM b WHERE place > 1)),
 n AS (SELECT o.*, row_number() OVER (PARTITION BY o.k, o.p, o.comp, lower(term) ORDER BY o.i, n) AS once FROM o JOIN b ON b.k = o.k AND b.p = o.p AND b.comp = o.comp AND place = 1 WHERE term <> '' AND NOT list_contains(list_transform(string_split(lower(b.g), ','), lambda x: trim(x)), lower(term))),
 x AS (SELECT k, p, comp, string_agg(term, ', ' ORDER BY i, n) AS more FROM n WHERE once = 1 GROUP BY ALL)
 SELECT b.k AS l_orderkey, b.p AS l_returnflag, b.it AS l_linenumber, b.g || coalesce(', ' || more, '') AS gloss, senses FROM b LEFT JOIN x USING (k, p, comp) WHERE place = 1""",
}
