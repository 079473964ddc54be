"""Whether a pair of a sentence and its English may stand as an example of a word: ordered reasons, and a score of its build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths in words, the rank below which a word is ordinary speech, most clauses, shares of English to
# other words, subordinating words.
LENGTHS, BAND, CLAUSES, RATIO = (5, 11), 5000, 2, (0.5, 2.0)
SUBORDINATING = ("que", "cuando", "aunque", "porque", "si", "mientras", "quien", "cual", "donde")
LOW, HIGH = "a-záéíóúüñ", "A-ZÁÉÍÓÚÜÑ"

#: The reasons in the order in which they are asked.
REASONS = (
    "length", "target absent", "proper noun", "trailing ellipsis", "no terminal punct", "dialogue dash", "all caps", "merged lines", "parenthetical",
    "junk chars", "no english", "english fragment", "length ratio", "identical sides", "no finite verb", "3+ clauses",
)


def _facts(pairs: DataFrame, ranks: DataFrame, finite: DataFrame) -> DataFrame:
    """(id, clauses, merged, hard, easy): what the tables of ranks and finite forms tell of each sentence."""
    words = F.regexp_extract_all(F.lower("sentence"), F.lit(f"[{LOW}]+"), F.lit(0))
    inner = F.regexp_extract_all("sentence", F.lit(f"(?<=[{LOW}]) +([{HIGH}][{LOW}]+)"), F.lit(1))
    none = F.lit(None).cast("string")
    each = F.concat(
        F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(False).alias("inner"))), F.transform(inner, lambda w: F.struct(F.lower(w).alias("word"), F.lit(True).alias("inner")))
    )
    rows = pairs.select("id", F.explode(F.concat(F.array(F.struct(none.alias("word"), F.lit(False).alias("inner"))), each)).alias("x")).select("id", "x.*")
    rows = rows.join(ranks.select("word", "rank"), "word", "left").join(finite.select("word", F.lit(True).alias("finite")).distinct(), "word", "left")
    own = F.col("word").isNotNull() & ~F.col("inner")
    return rows.groupBy("id").agg(
        F.count_if(own & F.col("finite").isNotNull()).alias("clauses"), F.max(F.col("inner") & F.col("rank").isNotNull()).alias("merged"),
        F.count_if(own & F.coalesce(F.col("rank") >= BAND, F.lit(True))).alias("hard"), F.count_if(own & (F.col("rank") < BAND)).alias("easy"),
    )


def _reason() -> Column:
    """The first of REASONS that holds, null if none does."""
    es, en, s, t = F.col("sentence"), F.coalesce("english", F.lit("")), F.rtrim(F.col("sentence")), F.rtrim(F.coalesce("english", F.lit("")))
    raw = F.regexp_extract_all(es, F.lit(f"[A-Za-z{HIGH[3:]}{LOW[3:]}]+"), F.lit(0))
    n = F.size(raw)
    at = F.filter(F.transform(raw, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.lower(x["w"]) == F.col("word"))
    pieces = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    share = pieces(en) / F.greatest(pieces(es), F.lit(1))
    tests = (
        ~n.between(*LENGTHS),
        F.size(at) == 0,
        F.forall(at, lambda x: x["w"].rlike(f"^[{HIGH}]") & (x["i"] > 0)),
        s.endswith("…") | s.endswith(".."),
        ~s.rlike('[.!?"»]$'),
        F.ltrim(es).rlike("^[-–—]"),
        (es == F.upper(es)) & (F.length(es) > 8),
        F.col("merged"),
        es.rlike("[()]"),
        es.rlike(r"[♪<>{}]|https?://|[0-9]{3,}"),
        F.trim(en) == "",
        t.endswith("...") | t.endswith("…"),
        ~share.between(*RATIO),
        F.lower(F.trim(en)) == F.lower(F.trim(es)),
        F.col("clauses") == 0,
        F.col("clauses") > CLAUSES,
    )
    out = F.lit(None).cast("string")
    for reason, holds in reversed(list(zip(REASONS, tests, strict=True))):
        out = F.when(holds, reason).otherwise(out)
    return out


def _score() -> Column:
    """Points for ordinary words and a middling length; off for hard words, commas, subordinate clauses and quotes."""
    words = F.regexp_extract_all(F.lower("sentence"), F.lit(f"[{LOW}]+"), F.lit(0))
    n, hard = F.size(words), F.col("hard")
    off = F.when(hard <= 1, 0.0).when(hard == 2, 0.15).otherwise(0.15 + 0.25 * (hard - 2))
    commas = F.least(F.length("sentence") - F.length(F.replace("sentence", F.lit(","))), F.lit(2))
    under = F.size(F.filter(words, lambda w: w.isin(*SUBORDINATING)))
    middle = sum(LENGTHS) / 2
    quotes = F.when(F.col("sentence").rlike('["«»“”]'), 0.12).otherwise(0.0)
    build = 0.10 * commas + 0.06 * F.greatest(F.lit(0), under - 1)
    return F.round(F.col("easy") / n - off - build - quotes + 0.08 + 0.10 * (1 - F.abs(n - middle) / middle), 6)


def gate(pairs: DataFrame, ranks: DataFrame, finite: DataFrame) -> DataFrame:
    """pairs (id, sentence, english, word) with reason (null: accepted) and, for accepted ones, score.

    ranks: word, rank. finite: word, the forms of verbs that make a clause. A sentence is looked up by its words, a row
    each; ids are unique. Null English: none. A word is asked for in lower case.
    """
    facts = pairs.join(_facts(pairs.select("id", "sentence"), ranks, finite), "id").withColumn("reason", _reason())
    return facts.withColumn("score", F.when(F.col("reason").isNull(), _score())).select(*pairs.columns, "reason", "score")
