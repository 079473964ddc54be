"""A boosted calibrator over table features, and the contract that outside models' answers must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_calibrator(rows: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3, seed: int = 7):
    """SIM10: a gradient-boosted classifier; training is distributed, the model has `trees` small trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [
        VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep"),
        GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=steps).fit(rows)


def confidence(model, rows: DataFrame) -> DataFrame:
    """rows with confidence, the model's probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn("confidence", vector_to_array("probability")[1])
    return scored.drop("__features", "rawPrediction", "probability", "prediction")


def reply_json(reply: Column, schema: str) -> Column:
    """UDF01, FUN06: the outermost braces of a model's reply as a struct; null if they hold no such JSON."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), schema)


def closed_set(answers: DataFrame, menu: DataFrame, item: str, answer: str, least: float = 0.0) -> DataFrame:
    """UDF02, UDF06: answers with verdict: accepted, abstained (no answer or too little confidence) or off menu.

    answers: item, answer, confidence; menu: item and answer. Several answers for one item are a violation: repeated.
    """
    counts = answers.groupBy(item).agg(F.count("*").alias("__n"))
    known = menu.select(item, F.col(answer).alias("__known")).distinct()
    joined = answers.join(counts, item).join(known, (answers[item] == known[item]) & (answers[answer] == known["__known"]), "left").drop(known[item])
    verdict = (
        F.when(F.col("__n") > 1, "repeated")
        .when(F.col(answer).isNull() | (F.coalesce("confidence", F.lit(1.0)) < least), "abstained")
        .when(F.col("__known").isNull(), "off menu")
        .otherwise("accepted")
    )
    return joined.withColumn("verdict", verdict).drop("__n", "__known")
