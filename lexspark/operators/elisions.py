"""Elided words back to full ones: tiers of candidates decided by evidence, a second hop, and counts merged into the target."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut

# Endings from which a d between vowels has dropped, and what they restore to. In order, first match counts.
DROPPED_D = (
    ("a'os", "ados"), ("a'as", "adas"), ("í'os", "idos"), ("í'as", "idas"), ("a'o", "ado"), ("a'a", "ada"), ("í'o", "ido"), ("í'a", "ida"),
)
# The same where the restored word must be known (or, for diminutives, its base in -ado, -ido or -udo).
DROPPED_D_KNOWN = (
    ("a['’][íi]tos", "aditos", "d_elision_diminutive"), ("a['’][íi]tas", "aditas", "d_elision_diminutive"),
    ("a['’][íi]to", "adito", "d_elision_diminutive"), ("a['’][íi]ta", "adita", "d_elision_diminutive"),
    ("u['’][íi]tos", "uditos", "d_elision_diminutive"), ("u['’][íi]tas", "uditas", "d_elision_diminutive"),
    ("u['’][íi]to", "udito", "d_elision_diminutive"), ("u['’][íi]ta", "udita", "d_elision_diminutive"),
    ("[íi]['’][íi]tos", "iditos", "d_elision_diminutive"), ("[íi]['’][íi]tas", "iditas", "d_elision_diminutive"),
    ("[íi]['’][íi]to", "idito", "d_elision_diminutive"), ("[íi]['’][íi]ta", "idita", "d_elision_diminutive"),
    ("a['’]us", "ados", "d_elision_u_final"), ("a['’]u", "ado", "d_elision_u_final"),
    ("i['’]os", "idos", "d_elision_unaccented"), ("i['’]as", "idas", "d_elision_unaccented"),
    ("i['’]o", "ido", "d_elision_unaccented"), ("i['’]a", "ida", "d_elision_unaccented"),
    ("u['’]os", "udos", "d_elision_ustem"), ("u['’]as", "udas", "d_elision_ustem"),
    ("u['’]o", "udo", "d_elision_ustem"), ("u['’]a", "uda", "d_elision_ustem"),
)
# Endings without an apostrophe, for words that aren't known; diminutives with the ending of the base that must be.
BARE_DIMINUTIVES = (("aítas", "aditas", "ado"), ("aítos", "aditos", "ado"), ("aíta", "adita", "ado"), ("aíto", "adito", "ado"))
BARE = (("íos", "idos"), ("ías", "idas"), ("aos", "ados"), ("ás", "adas"), ("ío", "ido"), ("ía", "ida"), ("ao", "ado"))
# Consonants that drop at the end of a word and inside it; how much more frequent the best of several must be.
FINAL, INNER = ("s", "d", "z", "r", "l", "n"), "bcdfghjklmnñpqrstvwxyz"
TIMES, LEAST = 4, 20

TIERS = ("mapping", "d_elision", "d_elision_ext", "double_elision", "trailing_apos", "internal_apos", "bare_d_elision")


def _spelled(ending: str) -> list[str]:
    """The plain endings that one with classes of characters stands for."""
    choices = [c if len(c) == 1 else c[1:-1] for c in re.findall(r"\[[^]]*\]|.", ending)]
    return ["".join(p) for p in product(*choices)]


def _rules(tier: str, known_tier: str | None = None, bare_tier: str | None = None) -> list[tuple]:
    """(tier, place, kind, ending, restored, ending of the word that must be known or None, whether the word must not be known)."""
    out = [(tier, i, tier, e, r, None, False) for i, (e, r) in enumerate(DROPPED_D)] if known_tier else []
    for i, (ending, restored, kind) in enumerate(DROPPED_D_KNOWN if known_tier else (), 100):
        # of a diminutive the base does too: -ado for -aditos
        checks = [restored, *[restored[:2] + "o"] * (kind == "d_elision_diminutive")]
        out += [(known_tier, 2 * i + j, kind if known_tier != tier else tier, e, restored, c, False) for e in _spelled(ending) for j, c in enumerate(checks)]
    if bare_tier:
        out += [(bare_tier, i, bare_tier, e, r, base, True) for i, (e, r, base) in enumerate(BARE_DIMINUTIVES, 500)]
        out += [(bare_tier, i, bare_tier, e, r, r, True) for i, (e, r) in enumerate(BARE, 600)]
    return out


def _candidate(tier: Column, place: Column, kind: Column, full: Column, check: Column, unknown: Column) -> Column:
    """A struct; check: the word that must be known (null: none); unknown: the word that must not be (null: none)."""
    return F.struct(tier.alias("tier"), place.alias("place"), kind.alias("kind"), full.alias("full"), check.alias("check"), unknown.alias("unknown"))


def _by_ending(word: Column, rules: list[tuple]) -> Column:
    """The candidates of a word by its ending; none for null."""
    text = lambda x: "CAST(NULL AS STRING)" if x is None else "'" + x.replace("'", "\\'") + "'"
    # one expression from a string: thousands of column objects take seconds to make
    table = F.expr(
        "array(" + ", ".join(
            f"named_struct('tier', {TIERS.index(tier)}, 'place', {place}, 'kind', {text(kind)}, 'ending', {text(ending)}, 'restored', {text(restored)}, 'check', {text(check)}, 'unknown', {unknown})"
            for tier, place, kind, ending, restored, check, unknown in rules
        ) + ")"
    )
    fits = F.filter(table, lambda r: F.endswith(word, r["ending"]) & (F.length(word) > F.length(r["ending"])))

    def made(r: Column) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - F.length(r["ending"]))
        check = F.when(r["check"].isNotNull(), F.concat(stem, r["check"]))
        return _candidate(r["tier"], r["place"], r["kind"], F.concat(stem, r["restored"]), check, F.when(r["unknown"], word))

    return F.when(word.isNull(), F.array().cast(_CANDIDATES)).otherwise(F.transform(fits, made))


_CANDIDATES = "array<struct<tier: int, place: int, kind: string, full: string, check: string, unknown: string>>"


def candidates(words: DataFrame) -> DataFrame:
    """(word, tier, place, kind, full, check, unknown): what each word of the column `word` may stand for."""
    word = F.col("word")
    stem = F.when(word.endswith("'"), F.expr("left(word, length(word) - 1)"))
    plain = F.replace(word, F.lit("’"), F.lit("'"))
    one = (F.length(plain) - F.length(F.replace(plain, F.lit("'"))) == 1) & (F.length(plain) >= 3)
    at, letters = F.position(F.lit("'"), plain), F.replace(plain, F.lit("'"))
    none = F.lit(None).cast("string")

    def each(tier: str, consonants: tuple, full) -> Column:
        own = F.transform(F.array(*[F.lit(c) for c in consonants]), lambda c, i: _candidate(F.lit(TIERS.index(tier)), i, F.lit(tier), full(c), full(c), none))
        return F.filter(own, lambda x: x["full"].isNotNull())

    put = lambda base: lambda c: F.when(one, F.concat(F.substring(base, F.lit(1), at - 1), c, F.substring(base, at, F.length(base))))
    every = F.concat(
        _by_ending(word, _rules("d_elision", "d_elision_ext", "bare_d_elision")),
        _by_ending(stem, _rules("double_elision", "double_elision", "double_elision")),
        each("trailing_apos", FINAL, lambda c: F.when(F.length(word) >= 3, F.concat(stem, c))),
        each("internal_apos", tuple(INNER), put(letters)),
        each("internal_apos", tuple(INNER), put(F.when(F.contains(letters, F.lit("k")), F.replace(letters, F.lit("k"), F.lit("c"))))),
    )
    # words without an apostrophe or one of the bare endings have none
    likely = word.rlike("['’]") | word.rlike(f"({'|'.join(e for e, *_ in (*BARE_DIMINUTIVES, *BARE))})$")
    rows = words.where(likely).select("word", F.explode_outer(every).alias("x"))
    return rows.where("x is not null").select("word", "x.*")


def _evidence(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose check is known and whose unknown isn't, with the uses of the full word and whether it is registered."""
    seen = known.select(F.col("word").alias("check"), F.col("uses").alias("checked"))
    out = found.join(seen, "check", "left").where("check is null or checked is not null")
    out = out.join(known.select(F.col("word").alias("unknown")), "unknown", "left_anti")
    return out.join(known.select(F.col("word").alias("full"), "uses", "registered"), "full", "left").fillna({"uses": 0, "registered": False})


def restored(words: DataFrame, known: DataFrame, mapping: DataFrame) -> DataFrame:
    """(word, target, kind) of the words that stand for another one.

    words: word, distinct. known: word, uses, registered (a word of the trade, which keeps its apostrophe). mapping:
    word, target. The tiers, first that has a result: the mapping; a dropped d by apostrophe; its wider forms, if the
    result is known; a final apostrophe in front of which one of these shows; one of six consonants for a final
    apostrophe, if one result is known and used or registered, or the most used is used 20 times and four times as much
    as the next; a consonant for an inner apostrophe, if one result is known; a dropped d without apostrophe, if the word
    isn't known and the result is. A target that is itself of the last kind goes on to its own target.
    """
    hits = _evidence(cut(candidates(words), "candidates"), known)
    # a registered word keeps its final apostrophe
    kept = known.where("registered").select(F.concat("word", F.lit("'")).alias("word"), F.lit(True).alias("kept"))
    hits = hits.join(kept, "word", "left").where(~((F.col("tier") == TIERS.index("trailing_apos")) & F.col("kept").isNotNull()))
    hits = cut(hits, "hits")
    last = TIERS.index("trailing_apos"), TIERS.index("internal_apos")
    first = hits.where(~F.col("tier").isin(*last)).groupBy("word", "tier").agg(F.min_by(F.struct("full", "kind"), "place").alias("x"))
    first = first.select("word", "tier", "x.full", "x.kind")
    rated = F.sort_array(F.collect_set(F.struct("uses", "full")), asc=False)  # six consonants at most
    final = hits.where(F.col("tier") == last[0]).groupBy("word", "tier").agg(rated.alias("all"), F.collect_set(F.when(F.col("registered"), F.col("full"))).alias("own"))
    best, second = F.col("all")[0], F.coalesce(F.get("all", F.lit(1))["uses"], F.lit(0))
    pick = F.when(F.size("own") == 1, F.col("own")[0]).when(F.size("all") == 1, F.when(best["uses"] > 0, best["full"]))
    pick = pick.when((best["uses"] > 0) & (best["uses"] >= F.greatest(TIMES * second, F.lit(LEAST))), best["full"])
    final = final.select("word", "tier", pick.alias("full"), F.lit("trailing_apos").alias("kind")).where("full is not null")
    inner = hits.where(F.col("tier") == last[1]).groupBy("word", "tier").agg(F.min("full").alias("full"), F.count_distinct("full").alias("n"))
    inner = inner.where("n = 1").select("word", "tier", "full", F.lit("internal_apos").alias("kind"))
    given = mapping.join(words.select("word"), "word", "left_semi").select("word", F.lit(0).alias("tier"), F.col("target").alias("full"), F.lit("mapping").alias("kind"))
    every = given.unionByName(first).unionByName(final).unionByName(inner)
    chosen = cut(every.groupBy("word").agg(F.min_by(F.struct("full", "kind"), "tier").alias("x")).select("word", F.col("x.full").alias("target"), "x.kind"), "restored")
    # the second hop, over targets alone
    targets = chosen.select(F.col("target").alias("word")).distinct()
    on = targets.withColumn("x", F.explode(_by_ending(F.col("word"), _rules("bare_d_elision", None, "bare_d_elision"))))
    on = _evidence(on.select("word", "x.*"), known).groupBy("word").agg(F.min_by("full", "place").alias("next"))
    out = chosen.join(on.withColumnRenamed("word", "target"), "target", "left")
    return out.select("word", F.coalesce("next", "target").alias("target"), "kind")


def merged_counts(uses: DataFrame, links: DataFrame) -> DataFrame:
    """(word, uses, songs, variants): uses by (word, song, n), counted for the words that theirs stand for."""
    own = uses.join(links.select("word", "target"), "word", "left").withColumn("target", F.coalesce("target", "word"))
    each = own.groupBy("target", "song").agg(F.sum("n").alias("n"))
    sums = each.groupBy(F.col("target").alias("word")).agg(F.sum("n").alias("uses"), F.count("*").alias("songs"))
    forms = own.select("target", "word").distinct().groupBy("target").agg(F.count("*").alias("variants"))
    return sums.join(forms.withColumnRenamed("target", "word"), "word")
