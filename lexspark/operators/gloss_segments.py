"""Long glosses cut to what a card shows: split at top level, near-duplicates dropped, clauses and words capped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Most clauses of a gloss, and most words of a clause of three or more parts.
CLAUSES, WORDS = 3, 7
#: Marks of the two separators while a gloss is worked on.
CLAUSE, PART = "\u0001", "\u0002"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row: a column that is written into several places is worked out in each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marked(gloss: Column) -> Column:
    """The gloss with "; " and ", " outside brackets as marks; a closing bracket without an opening one counts for none."""
    pieces = F.regexp_extract_all(gloss, F.lit(r"[()]|[^()]+"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        own = F.when(acc["depth"] > 0, x).otherwise(F.replace(F.replace(x, F.lit("; "), F.lit(CLAUSE)), F.lit(", "), F.lit(PART)))
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.concat(acc["out"], own).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def segment_key(part: Column) -> Column:
    """What tells parts apart: lower case, without a leading "to", final punctuation and doubled spaces."""
    out = F.regexp_replace(F.lower(F.trim(part)), "[‘’“”]", "'")
    out = F.regexp_replace(F.regexp_replace(out, r"^to\s+", ""), r"[.,;:'\"]+$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _same(a: Column, b: Column) -> Column:
    """Equal, or equal but for a doubled last letter."""

    def double(short: Column, long: Column) -> Column:
        return (F.length(long) >= 2) & (long == F.concat(short, F.right(long, F.lit(1)))) & (F.right(short, F.lit(1)) == F.right(long, F.lit(1)))

    return (a == b) | double(a, b) | double(b, a)


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def card_gloss(gloss: Column) -> Column:
    """PRJ11: the gloss without repeated parts, at most three clauses, and clauses of three or more parts with at most seven words.

    Parts are what stands between "; " and ", " outside brackets. A part goes if an earlier kept one is the same by
    segment_key or but for a doubled last letter. A clause's first part always stays whole. Null: null.
    """
    text = F.trim(gloss)

    def keep(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda k: _same(k["key"], x["key"])), acc).otherwise(F.concat(acc, F.array(x)))

    def parted(whole: Column) -> Column:
        """The parts of a marked gloss: part, the mark in front of it, and key."""
        marks = F.concat(F.array(F.lit("")), F.regexp_extract_all(whole, F.lit(f"[{CLAUSE}{PART}]"), F.lit(0)))
        both = F.arrays_zip(F.split(whole, f"[{CLAUSE}{PART}]", -1).alias("x"), marks.alias("mark"))
        return F.transform(both, lambda z: F.struct(F.trim(z["x"]).alias("part"), z["mark"].alias("mark"), segment_key(z["x"]).alias("key")))

    def capped(own: Column) -> Column:
        """A clause of parts (part, n) with at most WORDS words, but the first part whole."""
        first = F.get(own, F.lit(0))

        def step(acc: Column, x: Column) -> Column:
            n = acc["n"] + x["n"]
            more = F.struct(F.concat(acc["out"], F.lit(", "), x["part"]).alias("out"), n.alias("n"), F.lit(False).alias("full"))
            stop = F.struct(acc["out"].alias("out"), n.alias("n"), F.lit(True).alias("full"))
            return F.when(acc["full"] | (n > WORDS), stop).otherwise(more)

        start = F.struct(first["part"].alias("out"), first["n"].alias("n"), F.lit(False).alias("full"))
        return F.aggregate(F.slice(own, 2, 1000), start, step, lambda acc: acc["out"])

    def cap(clause: Column) -> Column:
        counted = F.transform(F.split(clause, PART, -1), lambda x: F.struct(x.alias("part"), _words(x).alias("n")))
        return _once(counted, lambda own: F.when(F.size(own) > 2, capped(own)).otherwise(F.array_join(F.transform(own, lambda x: x["part"]), ", ")))

    def shown(kept: Column) -> Column:
        joined = F.aggregate(F.slice(kept, 2, 1000), F.get(kept, F.lit(0))["part"], lambda acc, x: F.concat(acc, x["mark"], x["part"]))
        return F.array_join(F.transform(F.slice(F.split(joined, CLAUSE, -1), 1, CLAUSES), cap), "; ")

    def cut(parts: Column) -> Column:
        return F.when(F.size(parts) <= 1, text).otherwise(_once(F.aggregate(parts, F.slice(parts, 1, 0), keep), shown))

    return _once(marked(text), lambda whole: _once(parted(whole), cut))
