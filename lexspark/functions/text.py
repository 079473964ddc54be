"""Column expressions on text: folding, tokens, scores and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}]+(?:'[\p{L}]+)*'?"

# Characters folded before text is compared.
QUOTES, QUOTE = "‘’`", "’"
DASHES = "–—"
CYRILLIC, LATIN = "еаорсхі", "eaopcxi"
WIDE_SPACES, NO_SPACES = "\u2005\u205f\u200a\u3000", "\u200b\ufeff"
# Words without their first syllable behind an apostrophe, and what they stand for.
LEADING_ELISIONS = (
    ("tamos", "estamos"), ("tamo", "estamos"), ("taba", "estaba"), ("tabas", "estabas"), ("toy", "estoy"), ("tá", "está"),
    ("tás", "estás"), ("tan", "están"), ("tán", "están"), ("onde", "donde"), ("el", "del"), ("e", "de"),
)
LYRIC_LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"

# Points of a line's score by its number of tokens.
GOOD_TOKENS, FAIR_TOKENS, LONG_TOKENS = (7, 16), (5, 20), 24
CONNECTORS = (
    "que", "pero", "si", "cuando", "porque", "aunque", "con", "sin", "me", "te", "se", "nos", "ya", "pa'", "pal", "pa", "al", "del", "la",
    "el", "los", "las",
)


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order: letters with inner apostrophes and one at the end."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def normalize_text(text: Column) -> Column:
    """One line-feed form, one quote and dash, plain spaces, none of no width, and Latin for seven Cyrillic look-alikes."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    plain = QUOTE * len(QUOTES) + "-" * len(DASHES) + LATIN + " " * len(WIDE_SPACES)
    return F.translate(out, QUOTES + DASHES + CYRILLIC + WIDE_SPACES + NO_SPACES, plain)


def lyric_tokens(line: Column) -> Column:
    """Counting tokens of a sung line: leading elisions in full, runs of short hyphened chunks dropped, lower case."""
    out = line
    for short, whole in sorted(LEADING_ELISIONS, key=lambda e: -len(e[0])):
        out = F.regexp_replace(out, f"(?iu)(?<![{LYRIC_LETTERS}])['’]{short}(?![{LYRIC_LETTERS}])", whole)
    chunk = f"[{LYRIC_LETTERS}]{{1,3}}"
    out = F.regexp_replace(out, rf"(?iuU)\b{chunk}(?:-{chunk})+\b", " ")
    return F.transform(F.regexp_extract_all(out, F.lit(f"[{LYRIC_LETTERS}]+(?:'[{LYRIC_LETTERS}]+)*'?"), F.lit(0)), F.lower)


def fold_accents(text: Column) -> Column:
    """Trimmed lower case without the accents of a closed alphabet; for matching, never for identity."""
    return F.translate(F.lower(F.trim(text)), ACCENTED, PLAIN)


def strip_adlibs(text: Column) -> Column:
    """Without bracketed parts and runs of two or more hyphened chunks of at most three letters."""
    out = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", " ")
    out = F.regexp_replace(out, r"(?i)\b[a-z]{1,3}(?:-[a-z]{1,3})+\b", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def good_context(toks: Column) -> Column:
    """At least five tokens, and not six or more of at most two kinds."""
    return (F.size(toks) >= 5) & ~((F.size(toks) >= 6) & (F.size(F.array_distinct(toks)) <= 2))


def line_score(toks: Column) -> Column:
    """Points for a middling length and a connector; very long lines lose two."""
    n = F.size(toks)
    score = F.when(n.between(*GOOD_TOKENS), 3).when(n.between(*FAIR_TOKENS), 1).otherwise(0)
    linked = F.arrays_overlap(toks, F.array(*[F.lit(c) for c in CONNECTORS]))
    return score + F.when(linked, 1).otherwise(0) - F.when(n > LONG_TOKENS, 2).otherwise(0)


def repetition(toks: Column) -> Column:
    """Whether all tokens are one."""
    return F.size(F.array_distinct(toks)) == 1


def gibberish(token: Column) -> Column:
    """Four equal letters in a row, six consonants in a row, or no vowel in three or more letters."""
    plain = fold_accents(token)
    return plain.rlike("(.)\\1\\1\\1") | plain.rlike("[bcdfghjklmnpqrstvwxz]{6}") | (
        (F.length(plain) >= 3) & ~plain.rlike("[aeiouy]")
    )


def sort_letters(word: Column) -> Column:
    """The word's letters in order."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def nesting_depth(text: Column) -> Column:
    """Deepest level of round brackets."""
    marks = F.split(F.regexp_replace(text, "[^()]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda acc: acc["most"])
