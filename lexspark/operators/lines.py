"""Documents to lines, tokens and n-grams, and the counts over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.session import cut, dealt, parts

# Thresholds of phrase mining, and the clitics of slot families.
PMI_LEAST, PMI_COUNT, PMI_DOCS = 15.0, 4, 3
NGRAM_SIZES = (2, 3, 4, 5)
#: Inner substrings of a kept phrase, about, that go into one step.
INNER = 100


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, line_no, line): each line of each text."""
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def tokenised(docs: DataFrame) -> DataFrame:
    """lines with toks and line_key, the tokens joined by spaces; lines without tokens are dropped."""
    out = lines(docs).withColumn("toks", T.tokens(F.col("line"))).where("size(toks) > 0")
    return out.withColumn("line_key", F.array_join("toks", " "))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """The first place of each different line of a document."""
    w = tokenised(dealt(docs.select("doc_id", "source", "text"), "doc_id")).groupBy("doc_id", "line_key").agg(F.min("line_no").alias("line_no"))
    return w.withColumn("toks", F.split("line_key", " "))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, corpus_count and doc_count: each different line counts once for each document."""
    words = distinct_lines(docs).select("doc_id", F.explode("toks").alias("word"))
    # a row for each word and document first: no list of documents is needed for the distinct count
    each = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("corpus_count"), F.count("*").alias("doc_count"))


def _keys(docs: DataFrame, makes: int = 1) -> DataFrame:
    """(doc_id, keys): the different stretches between punctuation of a document, each its tokens joined by spaces, also those without.

    Documents are dealt by id once; that layout serves all counts by document that follow. Rows of one id are one document.
    """
    whole = docs.select("doc_id", "text").repartition(parts(docs, makes), "doc_id").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    pieces = F.split(F.lower("text"), r"[\n.,;:!?()\[\]\"|]+")
    # the tokens of a piece are worked out in one place: a filter on them would be another
    return whole.select("doc_id", F.array_distinct(F.transform(pieces, lambda p: F.array_join(F.regexp_extract_all(p, F.lit(T.TOKEN), F.lit(0)), " "))).alias("keys"))


def stretches(docs: DataFrame, least: int, makes: int = 1) -> DataFrame:
    """(doc_id, line_key, toks): each different stretch between punctuation of a document, of `least` tokens or more."""
    toks = _keys(docs, makes).select("doc_id", F.explode_outer("keys").alias("line_key")).where("line_key <> ''")
    return toks.withColumn("toks", F.split("line_key", " ")).where(F.size("toks") >= least)


def _grams(chunks: DataFrame, sizes: tuple[int, ...], *kept: str) -> DataFrame:
    """kept, n, ngram: a row for each place of a stretch and each size.

    Places are rows before their n-grams are made: a slice inside a step of a list copies the whole list each time.
    """
    rows = chunks.select(*kept, "toks", F.explode_outer(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    places = F.when(F.size("toks") >= F.col("n"), F.sequence(F.lit(1), F.size("toks") - F.col("n") + 1))
    rows = rows.select(*kept, "toks", "n", F.explode_outer(places).alias("i")).where("i is not null")
    return rows.select(*kept, "n", F.array_join(F.slice("toks", F.col("i"), F.col("n")), " ").alias("ngram"))


def ngrams(docs: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """(doc_id, line, n, ngram) within stretches between punctuation, each different one once a document; line is its hash."""
    chunks = stretches(docs, min(sizes), len(sizes)).select("doc_id", F.xxhash64("line_key").alias("line"), "toks")
    return _grams(chunks, sizes, "doc_id", "line")


def _windows(docs: DataFrame, sizes: tuple[int, ...], lines: bool) -> DataFrame:
    """(pair, at, doc and, if asked for, line): a row for each place of a stretch: the words from it on, as many as the largest size has.

    pair: the first two. doc and line are sums of bits, one for each size (1 << size): of places of a document, or of a
    stretch, whose first words are equal one has the bit. Places are sorted by their words, so that equal first words lie
    beside each other and each needs but the one in front: a document's places are sorted once for all sizes.
    """
    most = max(sizes)

    def marks(all_: Column, i: Column, text) -> Column:  # noqa: ANN001
        now, before = text(F.get(all_, i)), text(F.get(all_, i - 1))
        first = lambda x, n: F.substring_index(x, " ", n)
        return reduce(Column.__add__, [F.when((i > 0) & (first(now, n) == first(before, n)), 0).otherwise(1 << n) for n in sizes])

    def places(toks: Column) -> Column:
        text = lambda i: F.concat_ws(" ", *[F.get(toks, i + k) for k in range(most)])
        return F.transform(F.sequence(F.lit(0), F.size(toks) - 1), text)

    def marked(texts: Column) -> Column:
        return F.transform(F.array(F.sort_array(texts)), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("at"), marks(t, i, lambda y: y).alias("line"))))[0]

    rows = _keys(docs, len(sizes)).select(F.transform(F.filter("keys", lambda k: k != ""), lambda k: F.split(k, " ")).alias("toks"))
    each = (lambda toks: marked(places(toks))) if lines else places
    rows = rows.select(F.sort_array(F.flatten(F.transform("toks", each))).alias("all"))
    rows = rows.select("all", F.posexplode_outer("all").alias("i", "place")).where("place is not null")
    of = (lambda x: x["at"]) if lines else (lambda x: x)
    doc = marks(F.col("all"), F.col("i"), of)
    return rows.select(F.substring_index(of(F.col("place")), " ", 2).alias("pair"), of(F.col("place")).alias("at"), doc.alias("doc"), *[F.col("place.line").alias("line")] * lines)


def _counts_by_pair(docs: DataFrame, sizes: tuple[int, ...], lines: bool) -> DataFrame:
    """ngram_counts by the first two words of places, so that single words have a row for each pair they begin.

    A place of a stretch goes once, with the words of the largest size, to the part of its first two words, where the
    n-grams of all sizes are counted. Both steps, by document and by words, are dealt into parts by the bytes read.
    """
    placed = _windows(docs, sizes, lines).repartition(parts(docs, len(sizes)), "pair")
    names = ["doc", "line"] if lines else ["doc"]
    words = F.length("at") - F.length(F.translate("at", " ", "")) + 1
    rows = placed.select("pair", "at", *names, words.alias("words")).select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).where("words >= n")
    bit = lambda c: F.expr(f"shiftright({c}, n) & 1").cast("long").alias(c)
    rows = rows.select("n", F.expr("substring_index(at, ' ', n)").alias("ngram"), "pair", *[bit(c) for c in names])
    return rows.groupBy("n", "ngram", "pair").agg(F.count("*").alias("count"), *[F.sum(c).alias(f"{c}_count") for c in names]).drop("pair")


def _words_summed(counts: DataFrame) -> DataFrame:
    """Counts by pair with single words summed over their pairs."""
    words = counts.where("n = 1").groupBy("n", "ngram").agg(*[F.sum(c).alias(c) for c in counts.columns[2:]])
    return counts.where("n > 1").unionByName(words)


def ngram_counts(docs: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES, lines: bool = True) -> DataFrame:
    """n, ngram, count, doc_count and, if asked for, line_count (different document and line pairs)."""
    counts = _counts_by_pair(docs, sizes, lines)
    return _words_summed(cut(counts, "by-pair")) if 1 in sizes else counts


def pmi_phrases(
    docs: DataFrame, least: float = PMI_LEAST, count: int = PMI_COUNT, n_docs: int = PMI_DOCS, sizes: tuple[int, ...] = NGRAM_SIZES
) -> DataFrame:
    """n-grams with pointwise mutual information: log2 of their share over the product of their words' shares."""
    counts = _counts_by_pair(docs, (1, *sizes), lines=False).where((F.col("n") == 1) | ((F.col("count") >= count) & (F.col("doc_count") >= n_docs)))
    counts = _words_summed(cut(counts, "ngrams"))
    # how many there are of each size follows from the stretches' lengths
    n = F.size("toks")
    sums = stretches(docs, 1).agg(*[F.sum(F.greatest(n - F.lit(k - 1), F.lit(0))).alias(str(k)) for k in (1, *sizes)])
    totals = cut(sums.unpivot([], [str(k) for k in (1, *sizes)], "n", "total").withColumn("n", F.col("n").cast("int")), "totals")
    one = counts.where("n = 1").select(F.col("ngram").alias("word"), F.col("count").alias("uses"))
    n_one = totals.where("n = 1").select(F.col("total").alias("words"))
    kept = counts.where("n > 1")
    words = kept.select("n", "ngram", "count", "doc_count", F.explode(F.split("ngram", " ")).alias("word"))
    words = words.join(one, "word").groupBy("n", "ngram", "count", "doc_count").agg(F.sum(F.log2("uses")).alias("logs"))
    rated = words.join(totals, "n").join(F.broadcast(n_one), F.lit(True))  # one row
    pmi = F.log2("count") - F.log2("total") - F.col("logs") + F.col("n") * F.log2("words")
    return rated.select("n", "ngram", "count", "doc_count", F.round(pmi, 1).alias("pmi")).where(F.col("pmi") >= least)


def inner_strings(phrases: DataFrame) -> DataFrame:
    """(n, ngram): for each phrase all substrings of two or more words but fewer than its own, parts of outer words too."""
    rows = phrases.select("n", F.split("ngram", " ").alias("w"))
    rows = rows.withColumn("m", F.explode_outer(F.expr("filter(sequence(2, 5), m -> m < n)"))).where("m is not null")
    rows = rows.withColumn("i", F.explode(F.expr("sequence(0, n - m)"))).select("m", F.expr("slice(w, i + 1, m)").alias("w"))
    rows = rows.withColumn("a", F.explode(F.expr("sequence(1, length(w[0]))")))
    rows = rows.withColumn("b", F.explode(F.expr("sequence(1, length(w[m - 1]))")))
    text = F.expr("array_join(concat(array(substr(w[0], a)), slice(w, 2, m - 2), array(left(w[m - 1], b))), ' ')")
    return rows.select(F.col("m").alias("n"), text.alias("ngram")).distinct()


def overlap_dedupe(phrases: DataFrame) -> DataFrame:
    """Phrases that are no substring of a longer kept one; raw containment, so parts of words count.

    A kept phrase lists its few hundred inner substrings, so containment is an equi-join; phrases are dealt for the bytes
    that their substrings make. The substrings are never broadcast: Spark estimates them by their phrases' bytes, and a
    broadcast planned by that is kept when more arrive, as a join by shuffle has one exchange more.
    """
    phrases = cut(phrases.select("n", "ngram"), "phrases")
    kept = phrases.where(F.col("n") == max(NGRAM_SIZES))
    for n in sorted(NGRAM_SIZES, reverse=True)[1:]:
        inner = inner_strings(kept.repartition(parts(kept, INNER), "n", "ngram")).where(F.col("n") == n)
        own = phrases.where(F.col("n") == n).join(inner.hint("merge"), ["n", "ngram"], "left_anti")
        kept = cut(kept.unionByName(own), "kept")
    return kept


def caps_stats(docs: DataFrame) -> DataFrame:
    """word, total, midcap, firstcap and rate: capital first letters inside and at the start of lines."""
    words = lines(docs).select(F.posexplode(F.regexp_extract_all("line", F.lit(T.TOKEN), F.lit(0))).alias("i", "surface"))
    cap = F.col("surface").rlike(r"^\p{Lu}")
    flagged = words.select(F.lower("surface").alias("word"), (cap & (F.col("i") > 0)).cast("int").alias("m"), (cap & (F.col("i") == 0)).cast("int").alias("f"))
    sums = flagged.groupBy("word").agg(F.count("*").alias("total"), F.sum("m").alias("midcap"), F.sum("f").alias("firstcap"))
    left = F.col("total") - F.col("firstcap")
    rate = F.when((F.col("midcap") > 0) & (left > 0), F.round(F.col("midcap") / left, 3)).otherwise(0.0)
    return sums.withColumn("rate", rate)


def top_lines(docs: DataFrame, k: int = 3) -> DataFrame:
    """Up to k lines for each word and document, by score, then first; other lines only where no line is good."""
    scored = distinct_lines(docs).withColumn("score", T.line_score(F.col("toks"))).withColumn("good", T.good_context(F.col("toks")))
    each = scored.select("doc_id", "line_no", "line_key", "score", "good", F.explode(F.array_distinct("toks")).alias("word"))
    order = W.partitionBy("word", "doc_id").orderBy(F.desc("good"), F.desc("score"), "line_no")
    any_good = F.max(F.col("good").cast("int")).over(W.partitionBy("word", "doc_id"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("any", any_good).where("good or any = 0").select("word", "doc_id", "line_no", "score", "rank")
