"""Rule tables over words: derivation, plurals, clitics, elisions, stems, cognates, parts of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import fold_accents

# Suffixes of diminutives and superlatives, least stem, and endings to try, in order.
DERIVATIONS = (
    ("ísimos", 3, ("os", "o")), ("ísimas", 3, ("as", "a")), ("ísimo", 3, ("o", "")), ("ísima", 3, ("a", "")),
    ("ecito", 2, ("e", "", "o")), ("ecita", 2, ("a", "e", "")),
    ("citos", 3, ("es", "s", "", "o", "a", "e")), ("citas", 3, ("as", "s", "", "a", "o", "e")),
    ("cito", 3, ("", "e", "n")), ("cita", 3, ("a", "", "e")),
    ("ecitos", 2, ("es", "s", "", "o", "a", "e")), ("ecitas", 2, ("as", "es", "", "a", "o", "e")),
    ("itos", 3, ("os", "es", "s", "", "o", "a", "e")), ("itas", 3, ("as", "es", "s", "", "a", "o", "e")),
    ("ito", 3, ("o", "e", "")), ("ita", 3, ("a", "e", "")),
    ("illos", 3, ("os", "es")), ("illas", 3, ("as", "es")), ("illo", 3, ("o", "e", "")), ("illa", 3, ("a", "e", "")),
)

# Spanish endings and the English ones of transparent cognates, in order.
COGNATES = (
    ("cion", "tion"), ("sion", "sion"), ("ancia", "ance"), ("encia", "ence"), ("amente", "ly"), ("mente", "ly"), ("ismo", "ism"),
    ("ista", "ist"), ("ivo", "ive"), ("iva", "ive"), ("oso", "ous"), ("osa", "ous"), ("ico", "ic"), ("ica", "ic"), ("idad", "ity"),
    ("dad", "ty"), ("ente", "ent"), ("ante", "ant"), ("ia", "y"), ("ario", "ary"), ("aria", "ary"), ("izar", "ize"),
    ("ificar", "ify"), ("ado", "ated"), ("ada", "ated"), ("ado", "ed"), ("ada", "ed"), ("ar", "ate"), ("mento", "ment"),
    ("ura", "ure"), ("cto", "ct"), ("ido", "id"), ("il", "ile"), ("or", "or"), ("al", "al"), ("ble", "ble"),
)

# Object pronouns that stand behind a verb, longest first.
ENCLITICS = ("nos", "los", "las", "les", "me", "te", "se", "lo", "la", "le", "os")

# Order of substring tests on a part-of-speech label; "noun" comes before "pronoun" on purpose.
POS_TESTS = (
    ("noun", "NOUN"), ("verb", "VERB"), ("adjective", "ADJ"), ("adverb", "ADV"), ("pronoun", "PRON"), ("article", "DET"),
    ("determiner", "DET"), ("interjection", "INTJ"), ("preposition", "ADP"), ("conjunction", "CCONJ"), ("number", "NUM"),
    ("numeral", "NUM"), ("particle", "PART"), ("contraction", "CONTRACTION"), ("abbreviation", "NOUN"), ("symbol", "NOUN"),
    ("unit", "NOUN"), ("letter", "NOUN"),
)
# Labels that are looked up whole first.
POS_EXACT = {
    "noun": "NOUN", "plural noun": "NOUN", "proper noun": "PROPN", "verb": "VERB", "adjective": "ADJ", "adverb": "ADV", "pronoun": "PRON",
    "determiner": "DET", "article": "DET", "definite article": "DET", "indefinite article": "DET", "interjection": "INTJ", "preposition": "ADP",
    "conjunction": "CCONJ", "coordinating conjunction": "CCONJ", "subordinating conjunction": "CCONJ", "number": "NUM", "numeral": "NUM",
    "particle": "PART", "contraction": "CONTRACTION", "phrase": "PHRASE", "abbreviation": "NOUN", "symbol": "NOUN", "unit": "NOUN",
    "letter": "NOUN", "letter name": "NOUN",
}

# Suffix, least stem and what replaces the suffix; the first that fits.
STEM_RULES = (
    ("ying", 1, "y"), ("ies", 3, "y"), ("ied", 3, "y"), ("ing", 3, ""), ("tion", 4, "te"), ("ness", 4, ""), ("ment", 4, ""), ("ally", 4, "al"),
    ("ly", 2, ""), ("ed", 2, ""), ("er", 2, ""), ("es", 2, ""), ("s", 1, ""),
)

# First words that mark a parenthesis or a note as a clarification of the gloss.
CLARIFIERS = (
    "used", "especially", "usually", "often", "expressing", "indicating", "introducing", "denotes", "denoting", "state", "adverbial", "in", "for",
    "with", "as", "when", "because", "can", "may", "e.g.", "i.e.", "including", "similar", "sometimes", "literally", "figuratively", "by", "from",
    "implies", "also", "regarded", "accusative", "dative", "genitive", "nominative", "declined", "apocopic", "conjugated", "inflected", "preceded",
)


def derivations(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, base): the first form that the lexicon knows, by rule, then ending; qu and gu give c and g before a or o.

    Each word explodes to its few candidates, which are looked up by an equi-join.
    """
    found = []
    for r, (suffix, least, endings) in enumerate(DERIVATIONS):
        stem = F.expr(f"substr(word, 1, length(word) - {len(suffix)})")
        bare = F.translate(stem, "áéíóú", "aeiou")
        forms = []
        for e, ending in enumerate(endings):
            order = r * 100 + e
            forms += [F.struct(F.lit(order).alias("o"), F.concat(s, F.lit(ending)).alias("base")) for s in (stem, bare)]
            if ending[:1] in ("o", "a"):
                for end, short in (("qu", "c"), ("gu", "g")):
                    swapped = F.regexp_replace(bare, f"{end}$", short)
                    forms.append(F.struct(F.lit(order).alias("o"), F.concat(swapped, F.lit(ending)).alias("base")))
        fits = F.col("word").endswith(suffix) & (F.length("word") - len(suffix) >= least)
        found.append(F.when(fits, F.array(*forms)).otherwise(F.array().cast("array<struct<o:int,base:string>>")))
    each = words.select("word", F.flatten(F.array(*found)).alias("c")).select("word", F.explode_outer("c").alias("c")).where("c is not null")
    hits = each.select("word", "c.o", "c.base").where("word <> base").join(lexicon.select(F.col("word").alias("base")), "base", "left_semi")
    return hits.groupBy("word").agg(F.min(F.struct("o", "base")).getField("base").alias("base"))


def plural_redirects(words: DataFrame) -> DataFrame:
    """(plural, singular): words that are another word's regular plural, accents apart; of several the shortest, then first."""
    folded = words.select("word", fold_accents(F.col("word")).alias("f"))
    plural = (
        F.when(F.col("f").endswith("z"), F.regexp_replace("f", "z$", "ces"))
        .when(F.col("f").rlike("[aeiou]$"), F.concat("f", F.lit("s")))
        .otherwise(F.concat("f", F.lit("es")))
    )
    singular = folded.select(F.col("word").alias("singular"), plural.alias("f"))
    met = folded.withColumnRenamed("word", "plural").join(singular, "f").where("plural <> singular")
    return met.groupBy("plural").agg(F.min(F.struct(F.length("singular").alias("n"), "singular")).getField("singular").alias("singular"))


def strip_clitics(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, host, clitics): up to two object pronouns off the end, accents stripped from the host, which must be known.

    One pronoun before two; longer pronouns first.
    """
    forms = []
    def add(tail: str, order: int) -> None:
        host = F.translate(F.expr(f"substr(word, 1, length(word) - {len(tail.replace('+', ''))})"), "áéíóú", "aeiou")
        fits = F.col("word").endswith(tail.replace("+", "")) & (F.length("word") - len(tail.replace("+", "")) >= 3)
        forms.append(F.when(fits, F.struct(F.lit(order).alias("o"), host.alias("host"), F.lit(tail).alias("clitics"))))

    for i, c in enumerate(ENCLITICS):
        add(c, i)
    for i, a in enumerate(("me", "te", "se", "nos", "os")):
        for j, b in enumerate(("los", "las", "lo", "la", "le", "les")):
            add(f"{a}+{b}", 100 + 10 * i + j)
    each = words.select("word", F.explode_outer(F.array_compact(F.array(*forms))).alias("c")).where("c is not null").select("word", "c.*")
    hits = each.join(lexicon.select(F.col("word").alias("host")), "host", "left_semi")
    best = hits.groupBy("word").agg(F.min(F.struct("o", "host", "clitics")).alias("b"))
    return best.select("word", "b.host", "b.clitics")


def cognates(spanish: DataFrame, english: DataFrame) -> DataFrame:
    """(es, en): pairs of words of four letters or more that are equal or that a suffix rule turns one into the other.

    Accents are folded and a plural s is dropped. Each Spanish word makes its few English forms; no pair is tried.
    """
    fold = lambda w: fold_accents(F.col(w))
    es = spanish.select(F.col("word").alias("es"), F.regexp_replace(fold("word"), "s$", "").alias("s")).where("length(es) >= 4")
    forms = [F.col("s")]
    for a, b in COGNATES:
        turned = F.concat(F.expr(f"substr(s, 1, length(s) - {len(a)})"), F.lit(b))
        forms.append(F.when(F.col("s").endswith(a) & (F.length("s") > len(a)), turned))
    made = es.select("es", F.explode(F.array_distinct(F.array_compact(F.array(*forms)))).alias("e"))
    en = english.select(F.col("word").alias("en"), F.explode(F.array_distinct(F.array(fold("word"), F.regexp_replace(fold("word"), "s$", "")))).alias("e"))
    return made.join(en.where("length(en) >= 4"), "e").select("es", "en").distinct()


def stem_en(word: Column) -> Column:
    """The word with the first suffix that fits and leaves enough replaced."""
    out = F.lower(word)
    for suffix, least, ending in reversed(STEM_RULES):
        low = F.lower(word)
        fits = low.endswith(suffix) & (F.length(low) - len(suffix) >= least)
        out = F.when(fits, F.concat(F.substr(low, F.lit(1), F.length(low) - len(suffix)), F.lit(ending))).otherwise(out)
    return out


def normalize_pos(label: Column) -> Column:
    """Tag of a part-of-speech label: exact ones first, then substrings in their order, else X."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.lit("X")
    for part, tag in reversed(POS_TESTS):
        out = F.when(low.contains(part), tag).otherwise(out)
    for exact, tag in POS_EXACT.items():
        out = F.when(low == exact, tag).otherwise(out)
    return out


def normalize_translation(gloss: Column) -> Column:
    """Lower case without "to", a leading subject and a trailing object pronoun, and the first word's third-person s."""
    out = F.regexp_replace(F.lower(F.trim(gloss)), "^to ", "")
    out = F.regexp_replace(out, "^(i|you|he|she|it|we|they) ", "")
    out = F.regexp_replace(out, " (me|you|him|her|it|us|them)$", "")
    return F.regexp_replace(out, "^([a-z]{3,})s( |$)", "$1$2")


def _first_word(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1)), r"[.,;:]+$", "")


def clean_gloss(gloss: Column) -> Column:
    """A gloss short enough for a card; never empty.

    What follows ": " or "; " if a description of over 30 characters precedes it and under 50 follow; without
    parentheses but short objects that begin with an article; of four comma parts or more the first three; of the
    semicolon parts those before a clarification, two comma parts of three or more, and three of four or more.
    """
    text = F.trim(gloss)
    for sep in ("; ", ": "):  # the outer one is tried first
        before = F.substring_index(text, sep, 1)
        after = F.trim(F.regexp_extract(text, f"(?s)^.*?{sep}(.*)$", 1))
        found = F.when(text.contains(sep) & (F.length(before) > 30) & (F.length(after) > 0) & (F.length(after) < 50), after)
        text_of = found if sep == "; " else F.coalesce(found, text_of, text)
    text = text_of
    paren = r"\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)"
    pieces, found = F.split(text, paren, -1), F.regexp_extract_all(text, F.lit(paren), F.lit(0))
    inner = lambda m: F.trim(F.regexp_extract(m, f"^{paren}$", 1))
    essential = lambda m: (
        _first_word(inner(m)).isin("a", "an", "the") & (F.length(inner(m)) < 25) & ~F.lower(inner(m)).rlike(r"etc|e\.g\.|i\.e\.")
    )
    kept = F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("m")), lambda z: F.concat(z["piece"], F.when(z["m"].isNotNull() & essential(z["m"]), z["m"]).otherwise("")))
    text = F.trim(F.array_join(kept, ""))
    commas = F.split(text, ", ", -1)
    text = F.when(F.size(commas) >= 4, F.array_join(F.slice(commas, 1, 3), ", ")).otherwise(text)
    parts = F.split(text, "; ", -1)
    note = F.array_position(F.transform(parts, lambda p: _first_word(p).isin(*CLARIFIERS)), F.lit(True)).cast("int")
    whole = F.when(note > 0, F.slice(parts, F.lit(1), note - 1)).otherwise(parts)
    short = F.transform(whole, lambda p: F.when(F.size(F.split(p, ", ", -1)) >= 3, F.array_join(F.slice(F.split(p, ", ", -1), 1, 2), ", ")).otherwise(p))
    text = F.when(F.size(parts) > 1, F.array_join(F.slice(short, 1, 3), "; ")).otherwise(text)
    text = F.regexp_replace(F.trim(text), "[,;]+$", "")
    return F.when(text == "", gloss).otherwise(text)


def pluralize(word: Column) -> Column:
    """Regular English plural."""
    return (
        F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )
