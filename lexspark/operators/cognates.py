"""How alike a Spanish word and an English gloss are (SIM01): rules in the JVM, a ratio of matching blocks for what no rule tells."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexspark.functions.text import fold_accents
from lexspark.operators.morphology import COGNATES

LEAST_LETTERS, SOUND_LETTERS = 4, 6
# English letters as Spanish writes the sound; y between consonants comes after them.
SOUNDS = (("ph", "f"), ("th", "t"), ("qu", "cu"))


def singular(word: Column) -> Column:
    """Without a Spanish or English plural."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    long = lambda n, end: (F.length(word) >= n) & word.endswith(end)
    return F.when(long(4, "ces"), F.concat(cut(3), F.lit("z"))).when(long(5, "es"), cut(2)).when(long(4, "s"), cut(1)).otherwise(word)


def without_first_e(word: Column) -> Column:
    """Without the e that Spanish puts before s and a consonant."""
    return F.regexp_replace(word, r"^e(?=s(?![aeiou])\p{L}.)", "")


def sounds(word: Column) -> Column:
    """An English word in Spanish letters."""
    out = reduce(lambda w, pair: F.replace(w, F.lit(pair[0]), F.lit(pair[1])), SOUNDS, word)
    # the letter before goes with the match: a y that has become an i is a vowel for the next one
    return F.regexp_replace(out, r"(^|[\p{L}&&[^aeiou]])y(?=\z|[\p{L}&&[^aeiou]])", "$1i")


def _by_rule(word: Column, *wanted: Column) -> Column:
    turned = [F.concat(F.substring(word, F.lit(1), F.length(word) - len(a)), F.lit(b)) for a, b in COGNATES]
    fits = [word.endswith(a) & (F.length(word) > len(a)) & t.isin(*wanted) for (a, _), t in zip(COGNATES, turned)]
    return reduce(lambda x, y: x | y, fits)


@F.pandas_udf(DoubleType())
def _best_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The best ratio of matching blocks over all pairs of two short lists of strings."""
    from difflib import SequenceMatcher

    return pd.Series([max((SequenceMatcher(None, a, b).ratio() for a in xs for b in ys), default=0.0) for xs, ys in zip(left, right)], dtype=float)


def cognate_scores(pairs: DataFrame, spanish: str, english: str) -> DataFrame:
    """pairs with `score`: 1 if equal or by a rule of endings, with or without the first e; else the best ratio to three places.

    Words under four letters and nulls have 0. From six letters on, the English word's sounds and the Spanish one without its first e
    are compared too. Only the given pairs are scored, each on its own row.
    """
    forms = pairs.withColumn("__s", fold_accents(F.coalesce(spanish, F.lit("")))).withColumn("__e", fold_accents(F.coalesce(english, F.lit(""))))
    forms = forms.withColumn("__s0", singular(F.col("__s"))).withColumn("__e0", singular(F.col("__e"))).withColumn("__s1", without_first_e(F.col("__s0"))).withColumn("__p", sounds(F.col("__e0")))
    s, s0, s1, e, e0, p = (F.col(f"__{c}") for c in ("s", "s0", "s1", "e", "e0", "p"))
    short = F.least(F.length(s), F.length(e)) < LEAST_LETTERS
    told = (s0 == e0) | _by_rule(s0, e0, e) | (s1 == e0) | _by_rule(s1, e0, e)
    long = (F.length(s0) >= SOUND_LETTERS) & (F.length(e0) >= SOUND_LETTERS)
    out = forms.withColumn("__told", F.when(short, 0.0).when(told, 1.0))
    # empty lists cost nothing: no block is sought where a rule has told
    both = lambda a, b: F.when(F.col("__told").isNotNull(), F.array().cast("array<string>")).when(long, F.array_distinct(F.array(a, b))).otherwise(F.array(a))
    return out.withColumn("score", F.coalesce("__told", F.round(_best_ratio(both(s0, s1), both(e0, p)), 3))).select(*pairs.columns, "score")
