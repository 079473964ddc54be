"""Queries at the edge of models (SIM10, UDF01, UDF02, UDF06, FUN06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import calibration as C
from lexspark.session import table


def calibrated_confidence(spark, sf_dir):
    """SIM10: confidence that a labelled document is good, learned from the others by three features (rows only)."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"), F.regexp_count("text", F.lit("[!#$%&*|]")).cast("double").alias("symbols"),
        F.size(F.array_distinct(F.split("text", " "))).cast("double").alias("kinds"), F.col("quality").cast("double").alias("label"),
    )
    model = C.fit_calibrator(rows.where("doc_id % 5 <> 0"), ["chars", "symbols", "kinds"], "label")
    return C.confidence(model, rows.where("doc_id % 5 = 0")).select("doc_id", F.round("confidence", 4).alias("confidence"))


def model_replies(spark, sf_dir):
    """UDF01, UDF02, UDF06: replies made of events, some broken, some off the menu, judged against the menu of users and items."""
    events = table(spark, sf_dir, "events")
    body = F.concat(F.lit("Sure: {\"sense\": \"k"), F.get_json_object("props", "$.k"), F.lit("\", \"confidence\": "), F.round(F.col("value") / 100, 2).cast("string"), F.lit("} Done."))
    reply = F.when(F.col("event_id") % 13 == 0, F.lit("I cannot say")).when(F.col("event_id") % 7 == 0, F.regexp_replace(body, '"k', '"q')).otherwise(body)
    parsed = events.select(F.col("event_id").alias("item"), C.reply_json(reply, "sense string, confidence double").alias("r")).select("item", "r.sense", "r.confidence")
    menu = events.select(F.col("event_id").alias("item"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("sense"))
    return C.closed_set(parsed, menu, "item", "sense", 0.1).groupBy("verdict").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (calibrated_confidence, model_replies)}
ORACLES = {
    "model_replies": """SELECT CASE WHEN event_id % 13 = 0 OR round(value / 100, 2) < 0.1 THEN 'abstained' WHEN event_id % 7 = 0 THEN 'off menu' ELSE 'accepted' END AS verdict, count(*) AS n FROM events GROUP BY 1""",
}
