"""Benchmark decontamination as a prefix-filtered set join on word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.numbering import numbered_as_written
from lexspark.session import cut

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: Words of the shingles that candidates are joined on.
SHINGLE = 4
#: A document is contaminated if 1 / MAX_SHARE of its words or more are hit.
MAX_SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, a-z (A-Z lower-cased) and everything beyond ASCII. Null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, WORD_GAP), "")


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items): each distinct window once, with the items that have it as strings in order.

    Items without words have none. An item of up to WINDOW words is one window.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    each = items.select(
        "item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), i -> slice(w, i + 1, {WINDOW}))")).alias("window")
    )
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _digest(words: list[str]) -> str:
    """128 bits of some words: two hashes that differ in what they begin with. SQL of a struct."""
    own = ", ".join(words)
    return f"struct(xxhash64({len(words)}, {own}) AS a, xxhash64({len(words) + SHINGLE}, {own}) AS b)"


def _hashes(sizes: list[int], words: str = "w") -> list[Column]:
    """For each size, the digests of the shingles of an array of words in order."""
    runs = [f"transform(sequence(0, size({words}) - {k}), i -> {_digest([f'{words}[i + {j}]' if j else f'{words}[i]' for j in range(k)])})" for k in sizes]
    none = "array_repeat(struct(0L AS a, 0L AS b), 0)"
    return [F.expr(f"CASE WHEN size({words}) >= {k} THEN {run} ELSE {none} END") for k, run in zip(sizes, runs, strict=True)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """docs with n_words, n_hit, n_items (long), items_sha256 (string) and contaminated (boolean).

    A document word is hit if it lies inside an occurrence of a window of the benchmark. n_items counts the items
    with an occurring window; items_sha256 is the SHA-256 of their ids as sorted strings, joined by commas.
    contaminated: n_hit > 0 and MAX_SHARE * n_hit >= n_words. Null or wordless text: zeros, the hash of the empty
    string, not contaminated. Empty benchmark: the same for every document. Repeated rows and items: each row for
    itself, each id once. Null item id: its windows hit, but it isn't counted. Columns named like the new ones are
    replaced.

    Windows must occur whole, so a window's rarest shingle is a prefix that is enough to find it: shingles are
    ordered by the number of their occurrences in docs, each window is joined on its rarest one, the occurrence must
    leave room on both sides (length and position), and then each of the window's shingles must stand at its place behind
    the start. Shingles are compared by digests of 128 bits, of which a word inside a window is in four. One pass over
    the texts keeps the places of any shingle of the benchmark, without words; everything else follows from those, and no
    text is moved or read again. One plan for every size of benchmark.
    """
    new = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    keep = [c for c in docs.columns if c.lower() not in new]
    windows = cut(numbered_as_written(windows_of(benchmark), "window_id"), "windows")
    stats = windows.agg(F.sort_array(F.collect_set(F.least(F.size("window"), F.lit(SHINGLE)))).alias("k")).first()
    sizes = list(stats["k"])
    # what a row gets depends on its text alone; the id only deals copies out
    row = F.struct(F.col(doc_id).alias("id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text"))
    own = docs.select(row.alias("__row"), words_of(F.col(text)).alias("w"))
    if sizes:
        hashed = own.select("__row", F.size("w").alias("n"), F.flatten(F.array(*_hashes(sizes))).alias("hashes"))
        # a window of fewer words than a shingle is one shingle
        runs = None
        for k in sizes:
            whole = _hashes([k], "window")[0]
            runs = whole if runs is None else F.when(F.least(F.size("window"), F.lit(SHINGLE)) == k, whole).otherwise(runs)
        shingles = cut(windows.select("window_id", F.size("window").alias("len"), F.posexplode(runs).alias("offset", "hash")), "shingles")
        distinct = shingles.select("hash").distinct()
        # where a size's digests begin in the flattened array, and which size stands at a place
        place, base = F.lit(None).cast("int"), F.lit(0)
        for k in sizes:
            n = F.greatest(F.col("n") - F.lit(k - 1), F.lit(0))
            place = F.when((F.col("pos") >= base) & (F.col("pos") < base + n), F.col("pos") - base).otherwise(place)
            base = base + n
        # outer: else a filter on the array's size is put below, which works it out once for each word
        at = hashed.select("__row", "n", F.posexplode_outer("hashes").alias("pos", "hash")).where("hash is not null")
        places = cut(at.select("__row", "n", "hash", place.alias("at")).join(cut(distinct, "distinct"), "hash", "left_semi"), "places")
        counts = cut(places.groupBy("hash").count(), "shingle-counts")
        prefix = shingles.join(counts, "hash").groupBy("window_id", "len").agg(
            F.min(F.struct(F.col("count").alias("n"), "offset", "hash")).alias("p"), F.count("*").alias("found")
        )
        # a window one of whose shingles stands nowhere occurs nowhere
        prefix = prefix.where(F.col("found") == F.greatest(F.col("len") - (SHINGLE - 1), F.lit(1)))
        prefix = cut(prefix.select("p.hash", "p.offset", "window_id", "len", "found"), "prefixes")
        near = places.join(prefix, "hash").withColumn("start", F.col("at") - F.col("offset"))
        near = near.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))).dropDuplicates(["__row", "start", "window_id"])
        near = cut(near.select("__row", "n", "start", "len", "found", "window_id"), "candidates")
        asked = near.join(shingles.select("window_id", "offset", "hash"), "window_id").withColumn("at", F.col("start") + F.col("offset"))
        stands = asked.join(places.select("__row", "at", "hash").distinct(), ["__row", "at", "hash"])
        found = stands.groupBy("__row", "n", "start", "len", "found", "window_id").agg(F.count("*").alias("k")).where("k = found")
        found = found.join(windows.select("window_id", "items"), "window_id").select("__row", "n", "start", "len", "items")
        hits = found.groupBy("__row").agg(
            F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
            F.max("n").cast("long").alias("__n"),
        )
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, s: F.struct(
                F.greatest(acc["end"], s["start"] + s["len"]).alias("end"),
                (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["end"], s["start"]))).alias("n"),
            ),
            lambda acc: acc["n"],
        )
        hits = hits.select("__row", "__n", covered.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
                           F.array_join("ids", ",").alias("__ids"))
    else:
        hits = own.where("false").select("__row", F.lit(0).cast("long").alias("__n"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("__ids"))
    hits = cut(hits, "hits")
    # the number of words is only worked out where it is asked for: a hit brings its own
    n_words = F.size(words_of(F.col(text))).cast("long")
    marked = docs.select(*keep, n_words.alias("n_words"), row.alias("__own"))
    marked = marked.join(hits, F.col("__own").eqNullSafe(F.col("__row")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return marked.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("__ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce((n_hit > 0) & (F.lit(MAX_SHARE) * n_hit >= F.col("__n")), F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns of docs."""
    return contamination(docs, benchmark).where("not contaminated").select(*docs.columns)
