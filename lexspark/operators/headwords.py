"""Which headword a form may have, and what stands before a verb (FLT10, FLT11, SIM15, MOR07, PRJ15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pronoun clusters that stand behind a verb, in the order in which they are tried.
ENCLITIC_CLUSTERS = (
    "selos", "selas", "melos", "melas", "noslo", "nosla", "telos", "telas", "selo", "sela", "melo", "mela", "telo", "tela", "nos", "los",
    "las", "les", "me", "te", "se", "lo", "la", "le", "os",
)
# Pronouns before a verb; those that may be reflexive; objects; persons that a pronoun agrees with.
CLITICS = ("me", "te", "se", "nos", "os", "lo", "la", "le", "los", "las", "les")
REFLEXIVE = ("me", "te", "se", "nos", "os")
OBJECTS = ("le", "les", "lo", "la", "los", "las")
PERSON_OF = (("me", "1"), ("nos", "1"), ("te", "2"), ("os", "2"))
# Tenses that a card shows, by mood and tense of the look-up; the last is the dictionary's name of the one before.
SHOWN_TENSES = (
    ("Presente", "indicativo", "presente"), ("Pretérito", "indicativo", "pretérito-perfecto-simple"), ("Imperfecto", "indicativo", "pretérito-imperfecto"),
    ("Futuro", "indicativo", "futuro"), ("Condicional", "condicional", "presente"), ("Subj. Presente", "subjuntivo", "presente"),
    ("Subj. Imperfecto", "subjuntivo", "pretérito-imperfecto-1"), ("Subj. Imperfecto", "subjuntivo", "pretérito-imperfecto"),
)
PERSONS = ("1s", "2s", "3s", "1p", "2p", "3p")
NONFINITE = (("gerund", ("gerundio",)), ("past_participle", ("participo", "participio-pasado")))
# Glosses that only say that a word is a name.
NAME_GLOSS = r"(?i)^\s*(?:a |an |the )?proper[\s-]*(?:noun|name)\b|^\s*(?:the )?name of\b"
NAME_POS = ("PROPN", "PROPER_NOUN", "PROPERNOUN")


def _chop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _clusters() -> Column:
    return F.array(*[F.lit(c) for c in ENCLITIC_CLUSTERS])


def form_variants(forms: DataFrame, form: str) -> DataFrame:
    """(form, variant): strings under which a form may stand in a table of conjugations: s restored, pronouns off, participles in -o.

    Step by step, each on its own rows: as one expression, every list would be worked out anew wherever it is used.
    """
    f = F.translate(form, "'’", "")
    behind = F.filter(_clusters(), lambda c: F.endswith(f, c) & (F.length(f) > F.length(c) + 1))
    out = forms.select(form, F.explode_outer(F.concat(F.array(f), F.transform(behind, lambda c: F.substring(f, F.lit(1), F.length(f) - F.length(c))))).alias("v"))
    out = out.select(form, F.explode_outer(F.array("v", F.concat("v", F.lit("s")))).alias("v"))
    v = F.col("v")
    folded = F.when(v.endswith("as") | v.endswith("os"), F.concat(_chop(v, 2), F.lit("o"))).when(v.endswith("a"), F.concat(_chop(v, 1), F.lit("o"))).otherwise(v)
    short = F.when(v.endswith("s"), _chop(v, 1)).otherwise(v)
    return out.select(form, F.explode_outer(F.array_distinct(F.array(v, folded, short))).alias("variant"))


def _noun_stem(x: Column) -> Column:
    x = F.when(x.endswith("es") & (F.length(x) > 3), _chop(x, 2)).when(x.endswith("s") & (F.length(x) > 2), _chop(x, 1)).otherwise(x)
    return F.when((F.length(x) > 2) & F.substring(x, -1, 1).isin("a", "o"), _chop(x, 1)).otherwise(x)


def noun_variants(s: Column, h: Column) -> Column:
    """Whether two forms are a regular pair of number or gender."""

    def plural(a: Column, b: Column) -> Column:
        ces = b.endswith("z") & (a == F.concat(_chop(b, 1), F.lit("ces")))
        return ces | (a == F.concat(b, F.lit("s"))) | (a == F.concat(b, F.lit("es")))

    return plural(s, h) | plural(h, s) | ((F.length(_noun_stem(s)) >= 3) & (_noun_stem(s) == _noun_stem(h)) & (s != h))


def vet_headwords(pairs: DataFrame, reverse: DataFrame, forms: DataFrame) -> DataFrame:
    """FLT10: pairs with `reason`: the first rule that makes the headword plausible for the surface, null if none does.

    pairs: surface, headword (both folded), relation, pointers (array of lemmas) and more; reverse: form, lemma; forms: form.
    In order: empty headword, the surface itself, flagged as an inflection, a pointer, the table of conjugations, a pronoun behind a
    verb, a known word's number or gender. Without known words nothing is vetted and every pair is kept as "unvetted". Look-ups are
    equi-joins of different pairs, so a repeated pair costs nothing more.
    """
    s, h = F.col("surface"), F.coalesce("headword", F.lit(""))
    without_se = lambda c: F.when(c.endswith("se"), _chop(c, 2)).otherwise(c)
    base = without_se(h)
    keys = pairs.where("surface is not null").select("surface", h.alias("__h")).distinct().withColumn("__base", without_se(F.col("__h")))
    # lemmas of each surface first: a pair then meets only those of its own surface
    lemmas = form_variants(keys.select("surface").distinct(), "surface").join(reverse.select(F.col("form").alias("variant"), "lemma").distinct(), "variant")
    lemmas = lemmas.select("surface", "lemma").distinct()
    wanted = keys.select("surface", "__h", F.explode_outer(F.array_distinct(F.array("__h", "__base"))).alias("lemma"))
    table = wanted.join(lemmas, ["surface", "lemma"], "left_semi").select("surface", "__h", F.lit(True).alias("__table")).distinct()
    heads = wanted.select("__h", F.col("lemma").alias("form")).distinct()
    verbs = heads.join(reverse.select("form").distinct(), "form", "left_semi").select("__h", F.lit(True).alias("__verb")).distinct()
    known = forms.select(F.col("form").alias("__h"), F.lit(True).alias("__known")).distinct()
    # an empty table of known words turns vetting off
    vetting = forms.limit(1).agg((F.count("*") > 0).alias("on")).scalar()

    infinitive = reduce(lambda a, b: a | b, [c.endswith(e) for c in (h, base) for e in ("ar", "er", "ir")])
    bare = F.exists(_clusters(), lambda c: (F.length(s) > F.length(c) + 1) & ((s == F.concat(h, c)) | (s == F.concat(base, c))))
    pointer = F.exists(F.coalesce("pointers", F.array().cast("array<string>")), lambda p: h.startswith(p) | p.startswith(h))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(~yes(vetting), "unvetted").when(F.trim(h) == "", "empty").when(s == h, "self")
        .when(yes(F.lower(F.trim("relation")).isin("conjugation", "inflection")), "flag").when(yes(pointer), "pointer").when(yes(F.col("__table")), "table")
        .when((yes(F.col("__verb")) | infinitive) & bare, "enclitic").when(yes(F.col("__known")) & noun_variants(s, h), "variant")
    )
    out = pairs.withColumn("__h", h).join(table, ["surface", "__h"], "left").join(verbs, "__h", "left").join(known, "__h", "left")
    return out.withColumn("reason", reason).select(*pairs.columns, "reason")


def purge_menu(menu: DataFrame, cache: DataFrame, reverse: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT11: (kept, quarantine) of a menu's analyses, both with its columns: only surfaces in the cache are vetted.

    menu: surface, headword, relation and more; cache: surface, pointers. A surface all of whose analyses fail has no row left.
    """
    held = menu.join(cache.select("surface", "pointers", F.lit(True).alias("__held")), "surface", "left")
    vetted = vet_headwords(held, reverse, forms)
    bad = F.col("__held").isNotNull() & F.col("reason").isNull()
    return vetted.where(~bad).select(*menu.columns), vetted.where(bad).select(*menu.columns)


def reflexive(target: Column, toks: Column, mode: str = "se-only", persons: Column | None = None) -> Column:
    """SIM15: whether the pronouns right before the target's first place make it reflexive; null for no opinion.

    "se-only" tells by se alone, "permissive" by any reflexive pronoun, "dative-aware" by agreement with `persons` (array of "1" to
    "3") of the target. All but the last are false without pronouns before it; without the target nothing is said.
    """
    at = F.array_position(toks, target)
    before = F.reverse(F.slice(toks, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    stop = F.array_position(F.transform(before, lambda t: ~t.isin(*CLITICS)), F.lit(True)).cast("int")
    cluster = F.when(stop > 0, F.slice(before, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(before)
    has = lambda *words: F.exists(cluster, lambda t: t.isin(*words))
    none = F.size(cluster) == 0
    if mode == "permissive":
        told = has(*REFLEXIVE)
    elif mode == "se-only":
        told = F.when(has("se"), True).when(none, False)
    else:
        agree = reduce(lambda a, b: a | b, [has(c) & F.array_contains(persons, p) for c, p in PERSON_OF])
        unknown = F.size(F.coalesce(persons, F.array().cast("array<string>"))) == 0
        told = F.when(has("se"), True).when(none | has(*OBJECTS), False).when(unknown, None).otherwise(agree)
    return F.when(at > 0, told)


def bare_form(form: Column, pronoun: Column) -> Column:
    """MOR07: a conjugated form without its pronoun and the no of a negative imperative, in lower case."""
    f = F.trim(form)
    f = F.when(f.startswith(F.concat(pronoun, F.lit(" "))), F.substring(f, F.length(pronoun) + 2, F.length(f))).otherwise(f)
    return F.lower(F.when(f.startswith("no "), F.substring(f, F.lit(4), F.length(f))).otherwise(f))


def reverse_lookup(paradigms: DataFrame) -> DataFrame:
    """MOR07: (form, lemma, mood, tense, person) of rows lemma, mood, tense, pronoun, number (s, p), person (1 to 3), form."""
    label = F.concat("person", "number")
    shown = F.when(F.col("mood").isin("gerundio", "participo", "participio-pasado") | ~F.coalesce(label.isin(*PERSONS), F.lit(False)), "").otherwise(label)
    return paradigms.select(bare_form(F.col("form"), F.coalesce("pronoun", F.lit(""))).alias("form"), "lemma", "mood", "tense", shown.alias("person"))


def fallback_tables(morphology: DataFrame, missing: DataFrame) -> DataFrame:
    """MOR07: (lemma, slot, person, form): tables of lemmas without a paradigm, from the dictionary's forms.

    morphology: ord, form, lemma, mood, tense, person. Each slot keeps the first form in the file's order; a lemma without a shown
    tense has no table, whatever else is known of it.
    """
    mood, tense = F.col("mood"), F.col("tense")
    slot = reduce(lambda w, t: w.when((mood == t[1]) & (tense == t[2]), t[0]), SHOWN_TENSES, F.when(F.lit(False), None))
    for name, moods in NONFINITE:
        slot = F.coalesce(F.when(mood.isin(*moods), name), slot)
    finite = ~mood.isin(*[m for _, moods in NONFINITE for m in moods])
    each = morphology.join(missing.select("lemma").distinct(), "lemma", "left_semi").select("lemma", slot.alias("slot"), F.when(finite, F.col("person")).otherwise("").alias("person"), "form", "ord", finite.alias("__finite"))
    each = each.where(F.col("slot").isNotNull() & (~F.col("__finite") | F.col("person").isin(*PERSONS)))
    first = each.groupBy("lemma", "slot", "person").agg(F.min_by("form", "ord").alias("form"), F.first("__finite").alias("__finite"))
    return first.join(first.where("__finite").select("lemma").distinct(), "lemma", "left_semi").drop("__finite")


def is_name_sense(kind: Column, pos: Column, gloss: Column) -> Column:
    """PRJ15: a proper noun by its stamp, its part of speech, or a gloss that only says so."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    canon = F.when(F.upper(F.trim(pos)).isin(*NAME_POS), "PROPN")
    return yes(kind == "proper_noun") | yes(canon == "PROPN") | yes(F.trim(gloss).rlike(NAME_GLOSS))


def carry_tags(meaning: Column, sense: Column, tags: tuple[str, ...] = ("type", "construction")) -> Column:
    """PRJ15: a meaning with the tags that its sense has; empty ones change nothing. Both are structs that have these fields."""
    for tag in tags:
        meaning = meaning.withField(tag, F.coalesce(F.nullif(sense.getField(tag), F.lit("")), meaning.getField(tag)))
    return meaning
