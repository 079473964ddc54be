"""Learner events as a stream: idempotent delivery, windows, stages by state, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.learner import TOP_STAGE, attempts
from lexspark.streaming.upsert_log import UpsertLog

LATE = "1 hour"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a folder of event files, some files at a time."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """PRG10: each event_id once, as long as a repeat comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    """events with a watermark; None: they have one already."""
    return events if late is None else events.withWatermark("ts", late)


def daily_counts(events: DataFrame, late: str | None = LATE) -> DataFrame:
    """Events by day and type."""
    counts = _marked(events, late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("day"), "event_type", "n")


def weekly_mistakes(events: DataFrame, late: str | None = LATE) -> DataFrame:
    """FLT17: wrong answers of each user in seven days, every day anew."""
    wrong = _marked(events, late).where("event_type = 'error'")
    counts = wrong.groupBy(F.window("ts", "7 days", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("since"), "user_id", "n")


def study_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = LATE) -> DataFrame:
    """Sessions of a user: events with at most a gap between them."""
    found = _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def srs_stages(events: DataFrame) -> DataFrame:
    """PRG02: the stage of each user and item after each batch with answers.

    State: the time and id of the last answer that counted, the stage, right and wrong answers. An answer older than
    the last one counts, but leaves the stage as it is.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, last, stage, right, wrong = state.get if state.exists else (-1, -1, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, event, correct in zip(rows["ts"].astype("int64"), rows["event_id"], rows["correct"], strict=True):
            right, wrong = right + bool(correct), wrong + (not correct)
            if (ts, event) > (at, last):
                at, last, stage = int(ts), int(event), min(stage + 1, TOP_STAGE) if correct else 0
        state.update((at, last, stage, right, wrong))
        yield pd.DataFrame({"user_id": [key[0]], "item": [key[1]], "srs_stage": [stage], "n_correct": [right], "n_wrong": [wrong]})

    answers = attempts(events).where("correct is not null")
    return answers.groupBy("user_id", "item").applyInPandasWithState(
        advance, "user_id long, item long, srs_stage int, n_correct long, n_wrong long", "at long, last long, stage int, right long, wrong long",
        "update", "NoTimeout",
    )


def upsert_sink(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], fields: list[str]):
    """PRG04: a query that keeps the newest value of each field of each key in an UpsertLog at path."""
    return UpsertLog(path, keys, order, fields).start(events, checkpoint)
