"""Streams over replayed events equal the batch results on the same rows."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import functions as F

from lexspark.operators import learner
from lexspark.streaming import learner_events as S
from lexspark.streaming.upsert_log import UpsertLog


@pytest.fixture(scope="module")
def replay(spark, sf, tmp_path_factory):
    """Events in four files in order of time, some of them twice."""
    root = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = events.selectExpr("percentile(cast(ts as long), array(0.25, 0.5, 0.75)) q").first()["q"]
    part = sum((F.col("ts").cast("long") > c).cast("int") for c in cuts)
    again = events.where("event_id % 10 = 0")
    for i in range(4):
        events.union(again).where(part == i).coalesce(1).write.mode("append").parquet(str(root))
    return str(root), events


def run(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_repeats_are_dropped(spark, replay, tmp_path):
    path, events = replay
    got = run(S.once(S.read_events(spark, path)), tmp_path, "once")
    assert got.count() == got.select("event_id").distinct().count() == events.count()


def test_daily_counts_equal_batch(spark, replay, tmp_path):
    path, events = replay
    got = run(S.daily_counts(S.once(S.read_events(spark, path)), None), tmp_path, "daily")
    want = events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    rows = {tuple(r) for r in got.collect()}
    assert rows <= {tuple(r) for r in want.collect()} and len(rows) >= 0.9 * want.count()  # the last day is still open


def test_sessions_do_not_overlap(spark, replay, tmp_path):
    path, _ = replay
    got = run(S.study_sessions(S.read_events(spark, path), "6 hours"), tmp_path, "sessions")
    by: dict = {}
    for r in got.collect():
        by.setdefault(r["user_id"], []).append((r["start"], r["end"]))
    assert by and all(a[1] <= b[0] for s in by.values() for a, b in zip(sorted(s), sorted(s)[1:], strict=False))


def test_weekly_mistakes(spark, replay, tmp_path):
    path, events = replay
    got = run(S.weekly_mistakes(S.once(S.read_events(spark, path)), None), tmp_path, "weekly").first()
    inside = events.where((F.col("event_type") == "error") & (F.col("user_id") == got["user_id"]))
    inside = inside.where((F.col("ts") >= F.lit(got["since"])) & (F.col("ts") < F.lit(got["since"]) + F.expr("INTERVAL 7 DAYS")))
    assert inside.count() == got["n"]


def test_stages_equal_batch(spark, replay, tmp_path):
    path, events = replay
    stream = S.srs_stages(S.once(S.read_events(spark, path, 4)))
    got = run(stream, tmp_path, "stages", "update")
    last = {(r["user_id"], r["item"]): (r["srs_stage"], r["n_correct"], r["n_wrong"]) for r in got.collect()}
    want = learner.progress(learner.attempts(events).where("correct is not null"))
    assert last == {(r["user_id"], r["item"]): (r["srs_stage"], r["n_correct"], r["n_wrong"]) for r in want.collect()}


def test_upsert_equals_batch(spark, replay, tmp_path):
    path, events = replay
    keys, order, fields = ["user_id", "event_type"], ["ts", "event_id"], ["value", "props"]
    query = S.upsert_sink(S.read_events(spark, path), str(tmp_path / "table"), str(tmp_path / "c"), keys, order, fields)
    query.awaitTermination()
    got = UpsertLog(str(tmp_path / "table"), keys, order, fields).read(spark)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in learner.latest(events, keys, order, fields).collect()}


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_upsert_log_writes_what_a_batch_brings(spark, tmp_path):
    """A small batch on a large state writes little, a replayed one changes nothing, touched buckets alone get a new base."""
    keys, order, fields = ["user", "item"], ["ts"], ["a", "b"]
    log = UpsertLog(str(tmp_path / "log"), keys, order, fields, buckets=8, every=2)
    schema = "user int, item int, ts int, a string, b int"
    large = [(u, i, 5, f"text {u} {i}", None if i % 3 else i) for u in range(200) for i in range(20)]
    small = [(1, 1, 4, "old", 9), (1, 2, 7, None, 8), (999, 0, 1, "new", None)]
    batches = [spark.createDataFrame(rows, schema) for rows in (large, small, small[:2], [(1, 2, 6, "late", 1)], [(5, 5, 9, "x", 1)])]
    whole = reduce(type(batches[0]).unionByName, batches)
    want = {tuple(r) for r in learner.latest(whole, keys, order, fields).collect()}
    log.append(batches[0], 0)
    first = _bytes(tmp_path / "log")
    log.append(batches[1], 1)  # compacts
    assert not list((tmp_path / "log/delta").iterdir()) and [p.name for p in (tmp_path / "log/base").iterdir()] == ["v=1"]
    log.append(batches[2], 2)
    assert _bytes(tmp_path / "log/delta") < first / 5
    log.append(batches[3], 3)  # compacts one or two of eight buckets
    assert sum(p.name.startswith("bucket=") for p in (tmp_path / "log/base/v=3").iterdir()) <= 2
    assert sum(p.name.startswith("bucket=") for p in (tmp_path / "log/base/v=1").iterdir()) >= 6
    log.append(batches[4], 4)
    assert {tuple(r) for r in log.read(spark).collect()} == want
    for n in (4, 3, 1):  # come again
        log.append(batches[n], n)
        assert {tuple(r) for r in log.read(spark).collect()} == want
    log.compact(spark, 4)
    assert {tuple(r) for r in log.read(spark).collect()} == want
