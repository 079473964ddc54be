"""Token scanners with offsets, substring counts, content ids with collisions, registries of methods."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SOURCE_TOKEN = r"['’‘ʼ`]?[\p{L}\p{M}]+(?:['’‘ʼ`][\p{L}\p{M}]+)*"

# Patterns of subtitle lines that are no speech.
SUBTITLE_JUNK = (r"https?://|www\.", r"(?i)subt[ií]tul|subtitle|sync|opensubtitles", r"^[\[(].*[\])]$", r"[♪♫#]", r"^[^\p{L}]*$", r"^\p{Lu}[\p{Lu} ]+:", r"<[^>]+>")


def source_tokens(rows: DataFrame, text: str, pattern: str = SOURCE_TOKEN) -> DataFrame:
    """TOK05, UDF08: rows with ordinal, start, end (code points, end exclusive) and surface of each token.

    Offsets are running sums of the lengths of the pieces between matches and of the matches, within one text. The other
    columns of rows must name a row.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    gaps = F.expr(f"transform(split({text}, '{quoted}', -1), s -> length(s))")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    both = F.arrays_zip(gaps.alias("gap"), found.alias("surface"))
    kept = [c for c in rows.columns if c != text]
    each = rows.select(*kept, F.posexplode_outer(both).alias("ordinal", "t")).select(*kept, "ordinal", "t.gap", "t.surface")
    # a running sum, as building the list of spans by appending would take the square of its length
    upto = W.partitionBy(*kept).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("surface"), F.lit(0))).over(upto).cast("int")
    each = each.withColumn("end", end).where("surface is not null")
    return each.select(*kept, "ordinal", (F.col("end") - F.length("surface")).alias("start"), "end", "surface")


def tokens_with_surfaces(line: str) -> Column:
    """TOK02: an array of (canonical, surface): lower case beside what the line shows."""
    return F.expr(rf"transform(regexp_extract_all({line}, '[\\p{{L}}]+(?:\'[\\p{{L}}]+)*\'?', 0), s -> struct(lower(s) AS canonical, s AS surface))")


def clean_subtitle(line: Column) -> Column:
    """PRJ06: null for junk, else the line without one leading dialogue dash."""
    junk = F.lit(False)
    for pattern in SUBTITLE_JUNK:
        junk = junk | line.rlike(pattern)
    return F.when(~junk, F.trim(F.regexp_replace(F.trim(line), "^[-–—] *", "")))


@F.pandas_udf(StringType())
def identity_normal(text: pd.Series) -> pd.Series:
    """PRJ07: composed, plain apostrophes, single spaces, case folded; the composed form has no SQL function."""
    def one(s):
        if s is None:
            return None
        s = unicodedata.normalize("NFC", s)
        for c in "’‘ʼ`´":
            s = s.replace(c, "'")
        return " ".join(s.split()).casefold()

    return text.map(one)


def substring_counts(lines: DataFrame, line: str, patterns: list[str]) -> DataFrame:
    """TOK08: (pattern, n): places of patterns in lines as plain substrings, by Aho-Corasick; patterns are a bounded list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            automaton.add_word(p, i)
        automaton.make_automaton()
        for pdf in batches:
            counts = [0] * len(patterns)
            for text in pdf[line].dropna():
                for _, i in automaton.iter(text):
                    counts[i] += 1
            yield pd.DataFrame({"pattern": patterns, "n": counts}).query("n > 0")

    return lines.select(line).mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def stable_ids(words: DataFrame, key: Column, digits: int = 6) -> DataFrame:
    """IDN01: words with id: the first digits of the key's MD5; of colliding keys the nth in order starts n - 1 digits later."""
    rows = words.withColumn("__key", key).withColumn("__md5", F.md5(key.cast("binary")))
    nth = F.row_number().over(W.partitionBy(F.substring("__md5", 1, digits)).orderBy("__key"))
    return rows.withColumn("id", F.substr(F.col("__md5"), nth, F.lit(digits))).drop("__key", "__md5")


class Registry:
    """UDF05: named methods from a frame to (id, sense, confidence); an unknown name is an error, never silence."""

    def __init__(self):
        self.methods: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, method: Callable[[DataFrame], DataFrame]) -> None:
        """Add a method under a new name."""
        if name in self.methods:
            raise ValueError(f"{name} is registered already")
        self.methods[name] = method

    def run(self, name: str, rows: DataFrame) -> DataFrame:
        """The method's rows, of exactly the three columns."""
        out = self.methods[name](rows)
        if sorted(out.columns) != ["confidence", "id", "sense"]:
            raise ValueError(f"{name} gives {out.columns}")
        return out
