"""Rules on senses, cards and transcriptions (FUN10-11, FLT09, FLT12, FLT24, FLT27, WIN22, SIM09, MOR02, AGG24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Parts of speech that a tagger tells reliably, and those that no tag rules out.
TRUSTED = ("VERB", "NOUN", "ADJ", "ADV", "INTJ")
ORTHOGONAL = ("PHRASE", "CONTRACTION")
# Senses that an example's tag allows where the two tag sets differ.
BRIDGE = (
    ("DET", ("ADJ", "DET", "PRON")), ("PRON", ("PRON", "ADJ", "DET")), ("NUM", ("ADJ", "NOUN", "DET")), ("PART", ("ADV", "ADP", "PRON")),
    ("PROPN", ("PROPN", "NOUN")), ("ADV", ("ADV", "PRON", "ADJ")),
)
# Elided words told by a neighbour: which side, the words there, and what it then is and else.
BEFORE_VEZ = ("una", "otra", "cada", "tal", "última", "primera", "esta", "esa", "la", "qué", "alguna", "cualquier")
ELIDED_BY_CONTEXT = (("ve'", -1, BEFORE_VEZ, "vez", "ves"), ("vo'", 1, ("a",), "voy", "vos"))


def strip_stress(phon: Column) -> Column:
    """FUN10: a transcription without stress marks."""
    return F.replace(phon, F.lit("'"), F.lit(""))


def strip_syllables(phon: Column) -> Column:
    """FUN10: without syllable marks; a double one is a hyphen of the word and stays as one."""
    return F.replace(F.replace(F.replace(phon, F.lit("--"), F.lit("%")), F.lit("-"), F.lit("")), F.lit("%"), F.lit("-"))


def stress_pattern(phon: Column) -> Column:
    """FUN11: 1 for each syllable that begins with a stress mark, else 0; its length is the number of syllables.

    A syllable is its first character, whatever it is, and all up to the next mark.
    """
    firsts = F.regexp_extract_all(phon, F.lit("(?s)(.)[^-]*-?"), F.lit(1))
    return F.array_join(F.transform(firsts, lambda c: F.when(c == "'", "1").otherwise("0")), "")


def fits_observed(sense: Column, observed: Column) -> Column:
    """FLT09: whether a sense's part of speech goes with the set observed for its word."""
    untrusted = F.size(F.array_except(observed, F.array(*[F.lit(p) for p in TRUSTED]))) > 0
    return sense.isin(*ORTHOGONAL) | F.array_contains(observed, sense) | (~sense.isin(*TRUSTED) & untrusted)


def fits_example(sense: Column, example: Column) -> Column:
    """FLT09: whether a sense goes with one example's tag; a trusted tag allows only itself."""
    return sense.isin(*ORTHOGONAL) | (sense == example) | (~example.isin(*TRUSTED) & ~sense.isin(*TRUSTED))


def fits_bridged(sense: Column, example: Column) -> Column:
    """FLT09: as fits_example, but tags of categories that the dictionary files elsewhere allow those."""
    out = fits_example(sense, example)
    for tag, allowed in BRIDGE:
        out = F.when(example == tag, sense.isin(*ORTHOGONAL, *allowed)).otherwise(out)
    return out


def unrenderable_reason(word: Column, abbreviations: Column, loanword: Column, clitic: Column) -> Column:
    """FLT12: why a word has no entry; described, not decided."""
    return (
        F.when(F.array_contains(abbreviations, word), "abbreviation").when(loanword, "english loanword")
        .when(clitic, "clitic form with no dictionary entry of its own").otherwise("no sense menu")
    )


def visible(flags: list[Column], senses: Column, cognate: Column, threshold: Column, uses: Column) -> Column:
    """FLT24: no flag set, a sense that is no proper noun, a cognate score below the threshold, and over one use."""
    barred = F.lit(False)
    for flag in flags:
        barred = barred | F.coalesce(flag, F.lit(False))
    real = F.coalesce(F.exists(senses, lambda s: s != "PROPN"), F.lit(False))
    return ~barred & real & (F.coalesce(cognate, F.lit(0.0)) < threshold) & (F.coalesce(uses, F.lit(0)) > 1)


def translation_key(text: Column) -> Column:
    """FLT27: lower-case words joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def untranslated(text: Column, english: Column) -> Column:
    """FLT27: whether a translation only repeats its source."""
    key = translation_key(text)
    return F.coalesce((key != "") & (key == translation_key(english)), F.lit(False))


def evidence_count(occurrences: Column, ids: Column, examples: Column) -> Column:
    """AGG24: different occurrences, else ids, else examples."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit(0)), F.lit(0))
    return F.coalesce(some(occurrences), some(ids), examples, F.lit(0))


def band_cuts(rows: DataFrame, confidence: str, right: str, targets: dict[str, float]) -> DataFrame:
    """WIN22: (band, cut): the lowest confidence down to which the share of right rows is the target; above all without one.

    Rows of one confidence count together, so that a running sum over different values is enough.
    """
    counts = rows.groupBy(F.col(confidence).alias("p")).agg(F.count("*").alias("n"), F.sum(right).alias("good"))
    down = W.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    curve = counts.select("p", (F.sum("good").over(down) / F.sum("n").over(down)).alias("share"))
    cuts = [F.round(F.coalesce(F.min(F.when(F.col("share") >= t, F.col("p"))), F.max("p") + 1e-6), 4).alias(b) for b, t in targets.items()]
    return curve.agg(*cuts).unpivot([], list(targets), "band", "cut")


def display_leaf(rows: DataFrame, item: str, leaf: str, group: str, score: str, defective: str, picked: str) -> DataFrame:
    """SIM09: (item, leaf): the picked leaf, or, if it is defective, the best sound one of its group if there is one.

    Of equal scores the smallest leaf.
    """
    pick = rows.where(picked).select(item, F.col(leaf).alias("__pick"), F.col(group).alias(group), F.col(defective).alias("__bad"))
    sound = rows.where(~F.col(defective)).join(pick.where("__bad"), [item, group]).groupBy(item)
    sound = sound.agg(F.max_by(leaf, F.struct(F.col(score), -F.col(leaf))).alias("__sound"))
    return pick.join(sound, item, "left").select(item, F.coalesce("__sound", "__pick").alias(leaf))


def ngram_tokens(toks: Column, simple: dict[str, str]) -> Column:
    """MOR02: tokens with elided ones in full, the ambiguous ones by the token before or behind."""

    def one(t: Column, i: Column) -> Column:
        out = t
        for short, whole in simple.items():
            out = F.when(t == short, whole).otherwise(out)
        for short, side, trigger, override, default in ELIDED_BY_CONTEXT:
            near = F.get(toks, i + side)
            out = F.when(t == short, F.when(near.isin(*trigger), override).otherwise(default)).otherwise(out)
        return out

    return F.transform(toks, one)
