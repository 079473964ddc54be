"""Queries on learner events (PRG01-10, EST01-08, AGG31, AGG32, FLT16, FLT17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import learner as P
from lexspark.operators import selection as S
from lexspark.session import table


def _tries(spark, sf_dir):
    return P.attempts(table(spark, sf_dir, "events"))


def _now(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))


def _state(spark, sf_dir):
    return P.state(P.progress(_tries(spark, sf_dir)), _now(spark, sf_dir))


def srs_stage_fold(spark, sf_dir):
    """PRG01, PRG02."""
    return P.progress(_tries(spark, sf_dir)).select("user_id", "item", "n_correct", "n_wrong", "srs_stage")


def progress_state(spark, sf_dir):
    """PRG03."""
    return _state(spark, sf_dir).select("user_id", "item", "state", "reason", "known")


def progress_upsert(spark, sf_dir):
    """PRG04, PRG05: one row for each user and event type, each field its newest value."""
    events = table(spark, sf_dir, "events").withColumn("high", F.when(F.col("value") > 50, F.col("value")))
    return P.latest(events, ["user_id", "event_type"], ["ts", "event_id"], ["value", "high", "props"])


def knowledge_merge(spark, sf_dir):
    """PRG06: counts summed over a user's items of one kind (item modulo 10), newest times, the newest one's stage."""
    rows = P.progress(_tries(spark, sf_dir)).withColumn("kind", F.pmod("item", F.lit(10)))
    newest = F.struct("last_seen", F.col("item"), "srs_stage")
    return rows.groupBy("user_id", "kind").agg(
        F.sum("n_correct").alias("n_correct"), F.sum("n_wrong").alias("n_wrong"), F.max("last_seen").alias("last_seen"),
        F.max(newest).getField("srs_stage").alias("srs_stage"),
    )


def review_reason(spark, sf_dir):
    """PRG07: for each user, incorrect before due, and the first time that matters."""
    rows = _state(spark, sf_dir).where("reason is not null")
    when = F.when(F.col("reason") == "incorrect", F.col("last_wrong")).otherwise(F.col("last_correct"))
    wrong = F.bool_or(F.col("reason") == "incorrect")
    return rows.groupBy("user_id").agg(
        F.when(wrong, "incorrect").otherwise("due").alias("reason"), F.count("*").alias("items"),
        F.date_format(F.coalesce(F.min(F.when(F.col("reason") == "incorrect", when)), F.min(when)), "yyyy-MM-dd HH:mm:ss").alias("since"),
    )


def import_merge(spark, sf_dir):
    """PRG08: an import of odd events into progress of even ones: the larger counts, the newest dates; twice is once."""
    tries = _tries(spark, sf_dir)
    old, new = (P.progress(tries.where(F.pmod("event_id", F.lit(2)) == k)) for k in (0, 1))
    both = old.alias("o").join(new.alias("n"), ["user_id", "item"], "full_outer")
    pick = lambda c: F.greatest(F.col(f"o.{c}"), F.col(f"n.{c}"))
    return both.select("user_id", "item", *[pick(c).alias(c) for c in ("n_correct", "n_wrong", "srs_stage")],
                       F.date_format(pick("last_seen"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def sync_queue(spark, sf_dir):
    """PRG09, PRG10: queued writes by key, the last payload at the first place, with the wait before try value % 4 + 1."""
    events = table(spark, sf_dir, "events")
    key = ["user_id", "event_type"]
    queued = events.groupBy(*key).agg(F.min("event_id").alias("place"), F.max(F.struct("event_id", "props")).getField("props").alias("payload"))
    tries = F.pmod("place", F.lit(4)).cast("int")
    return queued.select(*key, "place", "payload", F.least(F.lit(30), F.pow(F.lit(2), tries)).cast("int").alias("wait_s"))


def knowledge_summary(spark, sf_dir):
    """AGG32."""
    rows = _state(spark, sf_dir)
    return rows.groupBy("user_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("learned", "review", "unseen")])


def recent_mistakes(spark, sf_dir):
    """FLT16, FLT17: items missed in the last seven days."""
    rows = _state(spark, sf_dir)
    recent = (F.col("n_wrong") > 0) & (F.col("last_wrong") > F.timestamp_add("DAY", F.lit(-P.RECENT_DAYS), F.col("now")))
    return rows.where(recent).select("user_id", "item", "n_wrong")


def coverage_pct(spark, sf_dir):
    """AGG31: share of all use (events of an item) that a user's known items cover; items used once are hidden."""
    uses = _tries(spark, sf_dir).groupBy("item").agg(F.count("*").alias("uses")).where("uses > 1")
    total = uses.agg(F.sum("uses").alias("total"))
    known = _state(spark, sf_dir).where("known").join(uses, "item").groupBy("user_id").agg(F.sum("uses").alias("covered"))
    return known.join(F.broadcast(total), F.lit(True)).select("user_id", F.round(100 * F.col("covered") / F.col("total"), 4).alias("pct"))


def _ranked_items(spark, sf_dir):
    uses = _tries(spark, sf_dir).groupBy("item").agg(F.count("*").alias("uses"))
    return S.ranked(uses, "uses", "item").withColumn("rank", F.col("rank") - 1)


def estimation_bands(spark, sf_dir):
    """EST01: items in equal slices by use."""
    return P.bands(_ranked_items(spark, sf_dir), "rank").groupBy("band").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("items")
    )


def _band_answers(spark, sf_dir):
    banded = P.bands(_ranked_items(spark, sf_dir), "rank").select("item", "band")
    tries = _tries(spark, sf_dir).where("correct is not null").join(banded, "item")
    return tries.groupBy("band").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))


def isotonic_pava(spark, sf_dir):
    """EST02: right shares by band, fitted so that they don't rise."""
    rows = _band_answers(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("band", "n", "c"))).alias("b"))
    rows = rows.withColumn("share", F.expr("transform(b, x -> (x.c + 0.5D) / (x.n + 1))")).withColumn("weight", F.expr("transform(b, x -> cast(x.n as double))"))
    rows = rows.withColumn("fit", P.isotonic(F.col("share"), F.col("weight")))
    return rows.select(F.explode(F.arrays_zip(F.col("b.band").alias("band"), "share", "fit")).alias("x")).select(
        "x.band", F.round("x.share", 5).alias("share"), F.round("x.fit", 5).alias("fit")
    )


def estimate_interval(spark, sf_dir):
    """EST03: known items with a 90 % interval from Jeffreys posteriors by band."""
    sizes = P.bands(_ranked_items(spark, sf_dir), "rank").groupBy("band").agg(F.count("*").alias("size"))
    rows = _band_answers(spark, sf_dir).join(sizes, "band")
    a, b = F.col("c") + P.PRIOR, F.col("n") - F.col("c") + P.PRIOR
    mean, var = a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    sums = rows.agg(F.sum(mean * F.col("size")).alias("m"), F.sqrt(F.sum(var * F.col("size") * F.col("size"))).alias("s"))
    return sums.select(
        F.round("m", 3).alias("estimate"), F.round(F.greatest(F.lit(0.0), F.col("m") - P.Z * F.col("s")), 3).alias("low"),
        F.round(F.col("m") + P.Z * F.col("s"), 3).alias("high"),
    )


def next_band(spark, sf_dir):
    """EST04: the band whose question tells most: variance times size, less for each answer there."""
    sizes = P.bands(_ranked_items(spark, sf_dir), "rank").groupBy("band").agg(F.count("*").alias("size"))
    rows = _band_answers(spark, sf_dir).join(sizes, "band")
    a, b = F.col("c") + P.PRIOR, F.col("n") - F.col("c") + P.PRIOR
    worth = a * b / ((a + b) * (a + b) * (a + b + 1)) * F.col("size")
    return rows.withColumn("worth", F.round(worth, 9)).orderBy(F.desc("worth"), "band").limit(1).select("band", "worth")


def seen_items(spark, sf_dir):
    """EST07: items that a user has met in any mode."""
    return _tries(spark, sf_dir).select("user_id", "item").distinct().groupBy("item").agg(F.count("*").alias("users"))


QUERIES = {
    f.__name__: f
    for f in (
        srs_stage_fold, progress_state, progress_upsert, knowledge_merge, review_reason, import_merge, sync_queue, knowledge_summary,
        recent_mistakes, coverage_pct, estimation_bands, isotonic_pava, estimate_interval, next_band, seen_items,
    )
}

TRIES = """WITH tries AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item, ts,
  CASE WHEN event_type IN ('purchase', 'click') THEN true WHEN event_type = 'error' THEN false END AS correct FROM events)"""
PROGRESS = """flagged AS (SELECT *, max((ts, event_id)) FILTER (NOT correct) OVER (PARTITION BY user_id, item) AS lw FROM %s),
 %s AS (SELECT user_id, item, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_wrong, max(ts) FILTER (correct) AS last_correct,
  max(ts) FILTER (NOT correct) AS last_wrong, max(ts) AS last_seen, least(count(*) FILTER (correct AND (lw IS NULL OR (ts, event_id) > lw)), 7) AS srs_stage FROM flagged GROUP BY ALL)"""
STATE = f"""{TRIES}, {PROGRESS % ('tries', 'prog')}, dated AS (SELECT *, (SELECT max(ts) FROM events) AS now, last_correct + to_days([1, 3, 7, 14, 30, 60, 120][CAST(greatest(1, srs_stage) AS BIGINT)]) AS due,
  last_wrong IS NOT NULL AND (last_correct IS NULL OR last_wrong > last_correct) AS wrong FROM prog),
 reasoned AS (SELECT *, CASE WHEN wrong THEN 'incorrect' WHEN last_correct IS NOT NULL AND now >= due THEN 'due' END AS reason, NOT wrong AND last_correct IS NOT NULL AS known FROM dated),
 states AS (SELECT *, CASE WHEN last_correct IS NULL AND last_wrong IS NULL THEN 'unseen' WHEN reason IS NOT NULL THEN 'review' ELSE 'learned' END AS state FROM reasoned)"""
BANDS = f"""{TRIES}, uses AS (SELECT item, count(*) AS uses FROM tries GROUP BY item), ranked AS (SELECT item, uses, row_number() OVER (ORDER BY uses DESC, item) - 1 AS rank FROM uses),
 shape AS (SELECT count(*) AS total, greatest(1, least(10, count(*) // 40)) AS n FROM ranked), cuts AS (SELECT i AS band, i * total // n AS a, (i + 1) * total // n AS b FROM shape, unnest(range(n)) AS t(i)),
 banded AS (SELECT item, rank, band FROM ranked JOIN cuts ON rank >= a AND rank < b), sizes AS (SELECT band, count(*) AS size FROM banded GROUP BY band),
 answers AS (SELECT band, count(*) AS n, count(*) FILTER (correct) AS c FROM tries JOIN banded USING (item) WHERE correct IS NOT NULL GROUP BY band)"""
STAMP = "strftime(%s, '%%Y-%%m-%%d %%H:%%M:%%S')"
ORACLES = {
    "srs_stage_fold": f"{TRIES}, {PROGRESS % ('tries', 'prog')} SELECT user_id, item, n_correct, n_wrong, srs_stage FROM prog",
    "progress_state": f"{STATE} SELECT user_id, item, state, reason, known FROM states",
    "progress_upsert": """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(value, (ts, event_id)) FILTER (value > 50) AS high, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY ALL""",
    "knowledge_merge": f"""{TRIES}, {PROGRESS % ('tries', 'prog')} SELECT user_id, item % 10 AS kind, sum(n_correct) AS n_correct, sum(n_wrong) AS n_wrong, max(last_seen) AS last_seen,
  arg_max(srs_stage, (last_seen, item, srs_stage)) AS srs_stage FROM prog GROUP BY ALL""",
    "review_reason": f"""{STATE} SELECT user_id, CASE WHEN bool_or(reason = 'incorrect') THEN 'incorrect' ELSE 'due' END AS reason, count(*) AS items,
  {STAMP % "coalesce(min(last_wrong) FILTER (reason = 'incorrect'), min(last_correct))"} AS since FROM states WHERE reason IS NOT NULL GROUP BY user_id""",
    "import_merge": f"""{TRIES}, even AS (SELECT * FROM tries WHERE event_id % 2 = 0), odd AS (SELECT * FROM tries WHERE event_id % 2 = 1), {PROGRESS % ('even', 'o')},
 {(PROGRESS % ('odd', 'n')).replace('flagged', 'flagged2')} SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.item, n.item) AS item, greatest(o.n_correct, n.n_correct) AS n_correct,
  greatest(o.n_wrong, n.n_wrong) AS n_wrong, greatest(o.srs_stage, n.srs_stage) AS srs_stage, {STAMP % 'greatest(o.last_seen, n.last_seen)'} AS last_seen FROM o FULL JOIN n ON o.user_id = n.user_id AND o.item = n.item""",
    "sync_queue": "SELECT user_id, event_type, min(event_id) AS place, arg_max(props, event_id) AS payload, CAST(least(30, power(2, min(event_id) % 4)) AS INT) AS wait_s FROM events GROUP BY ALL",
    "knowledge_summary": f"""{STATE} SELECT user_id, count(*) FILTER (state = 'learned') AS learned, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'unseen') AS unseen FROM states GROUP BY user_id""",
    "recent_mistakes": f"{STATE} SELECT user_id, item, n_wrong FROM states WHERE n_wrong > 0 AND last_wrong > now - INTERVAL 7 DAY",
    "coverage_pct": f"""{STATE}, uses AS (SELECT item, count(*) AS uses FROM tries GROUP BY item HAVING count(*) > 1) SELECT user_id, round(100 * sum(uses) / (SELECT sum(uses) FROM uses), 4) AS pct
 FROM states JOIN uses USING (item) WHERE known GROUP BY user_id""",
    "estimation_bands": f"{BANDS} SELECT band, min(rank) AS first, max(rank) AS last, count(*) AS items FROM banded GROUP BY band",
    "isotonic_pava": f"""{BANDS}, s AS (SELECT band, n, (c + 0.5) / (n + 1) AS share FROM answers), runs AS (SELECT a.band AS j, b.band AS k, sum(c.share * c.n) / sum(c.n) AS mean FROM s a JOIN s b ON b.band >= a.band
  JOIN s c ON c.band BETWEEN a.band AND b.band GROUP BY ALL), tops AS (SELECT i.band, j, max(mean) AS top FROM s i JOIN runs ON j <= i.band AND k >= i.band GROUP BY ALL)
 SELECT band, round(share, 5) AS share, round(min(top), 5) AS fit FROM tops JOIN s USING (band) GROUP BY band, share""",
    "estimate_interval": f"""{BANDS}, p AS (SELECT c + 0.5 AS a, n - c + 0.5 AS b, size FROM answers JOIN sizes USING (band)), m AS (SELECT sum(a / (a + b) * size) AS m, sqrt(sum(a * b / ((a + b) * (a + b) * (a + b + 1)) * size * size)) AS s FROM p)
 SELECT round(m, 3) AS estimate, round(greatest(0.0, m - 1.645 * s), 3) AS low, round(m + 1.645 * s, 3) AS high FROM m""",
    "next_band": f"""{BANDS} SELECT band, round((c + 0.5) * (n - c + 0.5) / ((n + 1.0) * (n + 1.0) * (n + 2.0)) * size, 9) AS worth FROM answers JOIN sizes USING (band) ORDER BY worth DESC, band LIMIT 1""",
    "seen_items": f"{TRIES} SELECT item, count(DISTINCT user_id) AS users FROM tries GROUP BY item",
}
