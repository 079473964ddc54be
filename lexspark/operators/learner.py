"""Learner progress: answers to stages, states and reviews; levels by bands; coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Days from a right answer to the next review by stage, and the estimator's settings.
INTERVALS = (1, 3, 7, 14, 30, 60, 120)
TOP_STAGE = 7
BANDS, BAND_SIZE, Z, PRIOR = 10, 40, 1.645, 0.5
RECENT_DAYS = 7
RIGHT, WRONG = ("purchase", "click"), ("error",)


def attempts(events: DataFrame) -> DataFrame:
    """Events as (user_id, item, ts, event_id, correct): true, false or, where only seen, null."""
    correct = F.when(F.col("event_type").isin(*RIGHT), True).when(F.col("event_type").isin(*WRONG), False)
    item = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", "user_id", item.alias("item"), "ts", correct.alias("correct"))


def progress(tries: DataFrame) -> DataFrame:
    """(user_id, item) with counts, newest times and srs_stage: right answers since the last wrong one, TOP_STAGE at most.

    A partial aggregate by key. The run since the last wrong answer needs that answer first, so the stage comes from a
    window over one learner's answers to one item.
    """
    own = W.partitionBy("user_id", "item")
    at = F.struct("ts", "event_id")
    last_wrong = F.max(F.when(~F.col("correct"), at)).over(own)
    since = tries.withColumn("since", F.col("correct") & (last_wrong.isNull() | (at > last_wrong)))
    return since.groupBy("user_id", "item").agg(
        F.count_if("correct").alias("n_correct"),
        F.count_if(~F.col("correct")).alias("n_wrong"),
        F.max(F.when(F.col("correct"), F.col("ts"))).alias("last_correct"),
        F.max(F.when(~F.col("correct"), F.col("ts"))).alias("last_wrong"),
        F.max("ts").alias("last_seen"),
        F.least(F.count_if("since"), F.lit(TOP_STAGE)).cast("int").alias("srs_stage"),
    )


def interval_days(stage: Column) -> Column:
    """Days until the review after a right answer at a stage (1 to TOP_STAGE)."""
    days = F.array(*[F.lit(d) for d in INTERVALS])
    return F.element_at(days, F.greatest(F.lit(1), F.least(stage, F.lit(len(INTERVALS)))))


def state(rows: DataFrame, now: DataFrame) -> DataFrame:
    """rows with state and reason as of the one row of now (column now): unseen, review (incorrect or due) or learned."""
    rows = rows.join(F.broadcast(now), F.lit(True))
    due = F.timestamp_add("DAY", interval_days(F.col("srs_stage")), F.col("last_correct"))
    wrong = F.col("last_wrong").isNotNull() & (F.col("last_correct").isNull() | (F.col("last_wrong") > F.col("last_correct")))
    reason = F.when(wrong, "incorrect").when(F.col("last_correct").isNotNull() & (F.col("now") >= due), "due")
    answered = F.col("last_correct").isNotNull() | F.col("last_wrong").isNotNull()
    name = F.when(~answered, "unseen").when(reason.isNotNull(), "review").otherwise("learned")
    known = F.coalesce(~wrong & F.col("last_correct").isNotNull(), F.lit(False))
    return rows.withColumn("reason", reason).withColumn("state", name).withColumn("known", known)


def latest(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row for each key, each field the newest one that isn't null: an upsert of rows in order."""
    newest = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c))).getField(c).alias(c) for c in fields]
    return rows.groupBy(*keys).agg(*newest)


def bands(items: DataFrame, by: str) -> DataFrame:
    """items (with rank by `by`, from 0) with band: n = min(BANDS, N // BAND_SIZE) slices of floor bounds, at least one."""
    counted = items.agg(F.count("*").alias("total"))
    n = F.greatest(F.lit(1), F.least(F.lit(BANDS), F.floor(F.col("total") / BAND_SIZE))).cast("long")
    sized = items.join(F.broadcast(counted.select("total", n.alias("n"))), F.lit(True))
    # the band i with floor(i * N / n) <= rank < floor((i + 1) * N / n)
    guess = F.floor((F.col(by) + 1) * F.col("n") / F.col("total") - F.lit(1e-9))
    band = F.when(F.floor((guess + 1) * F.col("total") / F.col("n")) <= F.col(by), guess + 1)
    band = band.when(F.floor(guess * F.col("total") / F.col("n")) > F.col(by), guess - 1).otherwise(guess)
    return sized.withColumn("band", band.cast("int")).drop("total", "n")


def isotonic(values: Column, weights: Column) -> Column:
    """Weighted non-increasing fit of a short array: at each place the least over starts of the most over ends of means."""
    return F.transform(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: F.array_min(
            F.transform(
                F.sequence(F.lit(0), i),
                lambda j: F.array_max(
                    F.transform(
                        F.sequence(i, F.size(values) - 1),
                        lambda k: F.aggregate(
                            F.zip_with(F.slice(values, j + 1, k - j + 1), F.slice(weights, j + 1, k - j + 1), lambda v, w: v * w),
                            F.lit(0.0), lambda a, x: a + x,
                        )
                        / F.aggregate(F.slice(weights, j + 1, k - j + 1), F.lit(0.0), lambda a, x: a + x),
                    )
                ),
            )
        ),
    )
