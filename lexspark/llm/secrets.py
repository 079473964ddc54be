"""Secret scan: fixed patterns, and strings that pass a battery of randomness tests, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.session import cut

KINDS = ("assign", "access", "hex", "random")
#: Pattern of each kind, and what its whole match must meet.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
#: Candidates of the tests: whole runs with a digit; shorter ones have too few characters to tell.
LEAST_LENGTH = 20
RUN = "A-Za-z0-9+/_-"
CANDIDATE = f"(?<![{RUN}])(?=[A-Za-z+/_-]*[0-9])[{RUN}]{{{LEAST_LENGTH},}}"
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Name, pattern and alphabet of each encoding; the first that fits a candidate is its own.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _LOWER.upper() + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", ".*", _LOWER.upper() + _LOWER + _DIGITS + "-_+/"),
)
#: Share of false discoveries allowed among the candidates of one encoding and length band, and thresholds tried.
FALSE_SHARE = 0.1
THRESHOLDS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
_TINY = 1e-12


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), with an error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = F.lit(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = F.lit(c) + t * poly
    tail = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * t * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def _spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern with the lengths of what stands before each, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def battery(candidates: DataFrame) -> DataFrame:
    """match (string) to encoding, n and p: how well the characters pass as drawn evenly and independently.

    Chi-squared of the counts against equal shares of the alphabet (Wilson and Hilferty's normal form, upper tail),
    runs above and below its middle, and correlation of neighbours (both two-sided), joined by Fisher's method.
    """
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pattern, letters in reversed(ENCODINGS):
        fits = F.col("match").rlike(pattern)
        name, alphabet = F.when(fits, kind).otherwise(name), F.when(fits, letters).otherwise(alphabet)
    rows = candidates.withColumn("encoding", name).withColumn("alphabet", alphabet)
    rows = rows.withColumn("n", F.length("match")).withColumn("k", F.length("alphabet"))
    # one split, as substr() walks from the start for each place
    rows = rows.withColumn("v", F.expr("transform(slice(split(match, ''), 1, n), c -> locate(c, alphabet) - 1)"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    squares = F.expr("aggregate(array_distinct(v), 0L, (a, c) -> a + power(size(filter(v, x -> x = c)), 2) :: bigint)")
    rows = rows.withColumn("chi", squares * k / n - n)
    rows = rows.withColumn("high", F.expr("aggregate(v, 0, (a, x) -> a + if(2 * x >= k, 1, 0))").cast("double"))
    rows = rows.withColumn(
        "runs", F.expr("1 + aggregate(sequence(1, n - 1), 0, (a, i) -> a + if((2 * v[i] >= k) <> (2 * v[i - 1] >= k), 1, 0))")
    )
    rows = rows.withColumn("mean", F.expr("aggregate(v, 0L, (a, x) -> a + x)") / n)
    rows = rows.withColumn("spread", F.expr("aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
    rows = rows.withColumn(
        "lagged", F.expr("aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (v[i] - mean) * (v[i - 1] - mean))")
    )
    free = k - 1
    z_chi = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * free))) / F.sqrt(
        F.lit(2.0) / (9 * free)
    )
    expected = 2 * F.col("high") * (n - F.col("high")) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    two_sided = lambda z: F.lit(2.0) * _upper_tail(F.abs(z))
    p_chi = _upper_tail(z_chi)
    p_runs = F.when(variance > 0, two_sided((F.col("runs") - expected) / F.sqrt(variance))).otherwise(0.0)
    p_lag = F.when(F.col("spread") > 0, two_sided(F.col("lagged") / F.col("spread") * F.sqrt(n))).otherwise(0.0)
    half = -sum((F.log(F.greatest(p, F.lit(_TINY))) for p in (p_runs, p_lag)), F.log(F.greatest(p_chi, F.lit(_TINY))))
    p = F.exp(-half) * (1 + half + half * half / 2)
    return rows.withColumn("p", p).drop("alphabet", "k", "v", "chi", "high", "runs", "mean", "spread", "lagged")


def thresholds(tested: DataFrame) -> dict[tuple[str, int], float]:
    """For each encoding and length band (powers of two), the p from which candidates count as random.

    Random strings have an even p, others a small one. So twice the number with p >= 0.5, and one, estimates the random
    ones, and for each threshold the share of others above it follows; the least threshold with a share of at most
    FALSE_SHARE is taken, none if there is none. The one lets a lone key count whichever half its p is in; in large
    strata it weighs nothing. The driver gets one row for each encoding and band.
    """
    band = F.floor(F.log2("n")).cast("int")
    counts = [F.count_if(F.col("p") >= t).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)]
    found = {}
    for row in tested.groupBy("encoding", band.alias("band")).agg(F.count_if(F.col("p") >= 0.5).alias("even"), *counts).collect():
        for i, t in enumerate(THRESHOLDS):
            if row[f"t{i}"] and 1 - min(1.0, (1 - t) * (2 * row["even"] + 1) / row[f"t{i}"]) <= FALSE_SHARE:
                found[row["encoding"], row["band"]] = t
                break
    return found


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random (long), base_sha256 and spans (string); one row for each of docs.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. The patterns' spans (assign, access,
    hex) are leftmost and don't overlap within a kind; matches that are too short are dropped after matching. random
    adds runs that pass the battery at their stratum's threshold and touch no pattern's span. base_sha256 is the
    SHA-256 of the patterns' spans, joined by commas. Null, empty and clean texts: zeros, the hash of the empty
    string, an empty string. Repeated rows: each its own. Empty table: empty result. Other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    empty = F.expr("cast(array() as array<struct<gap: int, match: string>>)")
    once = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.when(body.rlike(ASSIGN), _spans(body, ASSIGN)).otherwise(empty).alias("s0"),
        F.when(body.contains("AKIA"), _spans(body, ACCESS)).otherwise(empty).alias("s1"),
        F.when(body.rlike(HEX), _spans(body, HEX)).otherwise(empty).alias("s2"),
        F.when(body.rlike(CANDIDATE), _spans(body, CANDIDATE)).otherwise(empty).alias("s3"),
    )
    once = cut(once, "matches")  # also fixes the numbers of rows
    tagged = [F.expr(f"transform(s{i}, s -> struct({i} AS kind, s.gap AS gap, s.match AS match))") for i in range(len(KINDS))]
    each = once.where("size(s0) + size(s1) + size(s2) + size(s3) > 0")
    each = each.select("row", F.posexplode(F.concat(*tagged)).alias("i", "s")).select("row", "i", "s.*")
    upto = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    length = F.coalesce(F.length("match"), F.lit(0))  # the last piece has no match behind it
    each = each.withColumn("stop", F.sum(F.col("gap") + length).over(upto)).where("match is not null")
    each = each.select("row", "kind", (F.col("stop") - F.length("match")).cast("int").alias("start"), F.col("stop").cast("int").alias("end"), "match")
    enough = (
        F.when(F.col("kind") == 0, F.length(F.regexp_extract("match", ASSIGNED, 1)) >= LEAST_ASSIGNED)
        .when(F.col("kind") == 1, F.length("match") >= LEAST_ACCESS)
        .otherwise(True)
    )
    each = cut(each.where(enough), "spans")
    tested = cut(battery(each.where("kind = 3").select("row", "start", "end", "match")), "tested")
    cuts = thresholds(tested)
    limit = F.lit(None).cast("double")
    for (encoding, band), t in sorted(cuts.items()):
        limit = F.when((F.col("encoding") == encoding) & (F.floor(F.log2("n")) == band), F.lit(t)).otherwise(limit)
    random = tested.where(F.col("p") >= limit).select("row", F.lit(3).alias("kind"), "start", "end")
    spans = each.where("kind < 3").select("row", "kind", "start", "end").unionByName(random)
    grouped = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    grouped = grouped.withColumn("base", base)
    # of the random ones, those apart from all others
    kept = F.filter(
        "all",
        lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    grouped = grouped.withColumn("all", kept)
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    number = lambda i: F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == i)), F.lit(0)).cast("long")
    counted = grouped.select(
        "row", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], shown("base").alias("base"), shown("all").alias("spans")
    )
    out = once.select("row", "doc_id").join(counted, "row", "left")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
