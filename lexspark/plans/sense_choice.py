"""A query on the calibrated choice of senses (SIM06, SIM07): labels as words, prototypes of labels as senses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import sense_scores as C
from lexspark.operators import similarity as S
from lexspark.session import cut, table


def calibrated_senses(spark, sf_dir):
    """SIM06, SIM07: of a label's menu of four prototypes the one chosen for each vector, with its gaps and the gates that held.

    The menu of label w has the prototypes of w to w + 3 (of ten) as senses; lemma, part of speech and translation follow
    the sense's number, a vector's tag and its evidence for or against "se" follow its id.
    """
    vectors = table(spark, sf_dir, "embeddings")
    prototypes = cut(S.prototypes(vectors, ["label"], "embedding", 3).select("label", F.col("prototype").alias("vector")), "prototypes")
    prototypes = C.hub_offsets(vectors.select(F.col("embedding").alias("vector")), prototypes)
    labels = vectors.groupBy("label").count().select(F.col("label").alias("word"))
    menu = labels.withColumn("place", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("sense", F.pmod(F.col("word") + F.col("place"), F.lit(10)))
    menu = menu.join(prototypes.withColumnRenamed("label", "sense"), "sense")
    menu = menu.withColumn("lemma", F.when(F.col("sense") % 2 == 0, "ir").otherwise("irse")).withColumn("sense_pos", F.when(F.col("sense") % 3 == 0, "noun").otherwise("verb"))
    menu = cut(menu.withColumn("translation", F.concat(F.lit("t"), F.floor(F.col("sense") / 2).cast("string"))), "menu")
    uses = vectors.select(
        F.col("vec_id").alias("use"), F.col("label").alias("word"), F.col("embedding").alias("vector"),
        F.when(F.col("vec_id") % 4 == 0, "noun").when(F.col("vec_id") % 4 == 1, "verb").alias("pos"),
        F.when(F.col("vec_id") % 5 < 2, F.col("vec_id") % 5 == 0).alias("reflexive"),
    )
    # a tuple's token score: the best inner product with its prototypes over every other dimension
    other = lambda c: F.filter(c, lambda x, i: i % 2 == 0)
    tokens = uses.join(menu.select("word", "lemma", "sense_pos", F.col("vector").alias("u")), "word")
    tokens = tokens.groupBy("use", "lemma", "sense_pos").agg(F.max(S.dot(other("vector"), other("u"))).alias("token_score"))
    rows = C.choose_senses(uses, menu, tokens, F.col("sense_pos") == F.col("pos"))
    return rows.withColumns({c: F.round(c, 6) for c in ("score", "tuple_gap", "class_gap")})


QUERIES = {"calibrated_senses": calibrated_senses}
