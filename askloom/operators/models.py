"""Fits with Spark ML in place of the small networks: fusion weight, confidence, tool policy, decomposition."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions import maths
from askloom.operators.audit import inverse_frequency_weights


def fit_alpha(rows: DataFrame, features: list[str], label: str, key: str, lo: float, hi: float, seed: int = 42) -> tuple[object, DataFrame]:
    """(model, scored rows): a weighted robust regression on the query features, learned from 90 % of the rows by hash.

    ``held_out`` marks the rows that were not learned from, ``abs_error`` is on all.
    """
    weighted = inverse_frequency_weights(rows, label).withColumn("held_out", maths.hash_unit(key, seed) >= 0.9)
    x = VectorAssembler(inputCols=features, outputCol="x").transform(weighted)
    model = LinearRegression(featuresCol="x", labelCol=label, weightCol="weight", loss="huber", maxIter=50, regParam=0.001).fit(x.filter("NOT held_out"))
    scored = model.transform(x).withColumn("alpha", maths.clip("prediction", lo, hi))
    return model, scored.select(key, label, "alpha", "held_out", F.abs(F.col("alpha") - F.col(label)).alias("abs_error"))


def fit_confidence(rows: DataFrame, query: str, evidence: str, label: str, key: str, share: float = 0.8, seed: int = 42) -> tuple[object, DataFrame]:
    """(model, rows with a predicted confidence in [0, 1]) from [query; mean evidence] vectors.

    Learned from a ``share`` of the rows by hash of the key; ``held_out`` marks the others, ``abs_error`` is on all.
    """
    joined = F.concat(F.transform(query, lambda v: v.cast("double")), F.transform(evidence, lambda v: v.cast("double")))
    x = rows.withColumn("x", array_to_vector(joined))
    x = x.withColumn("held_out", maths.hash_unit(key, seed) >= share)
    model = LinearRegression(featuresCol="x", labelCol=label, regParam=0.1, maxIter=50).fit(x.filter("NOT held_out"))
    scored = model.transform(x).withColumn("confidence", maths.clip("prediction", 0, 1)).drop("x", "prediction")
    return model, scored.withColumn("abs_error", F.abs(F.col("confidence") - F.col(label)))


def fit_classifier(rows: DataFrame, vector: str, label: str, key: str, multinomial: bool = False, share: float = 0.8, seed: int = 42) -> tuple[object, DataFrame]:
    """(model, rows with class probabilities): the tool policy (multinomial) or the multi-part detector (binary).

    Classes are weighted by their inverse frequency. Learned from a ``share`` of the rows by
    hash of the key; ``held_out`` marks the others, ``correct`` is on all.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    weighted = rows.join(sizes, label).withColumn("weight", sizes.agg(F.max("_n")).scalar() / F.col("_n")).drop("_n")
    x = weighted.withColumn("x", array_to_vector(F.transform(vector, lambda v: v.cast("double")))).withColumn("held_out", maths.hash_unit(key, seed) >= share)
    model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", regParam=0.01, maxIter=50, family="multinomial" if multinomial else "binomial").fit(x.filter("NOT held_out"))
    scored = model.transform(x).withColumn("probs", vector_to_array("probability")).drop("x", "rawPrediction", "probability")
    return model, scored.withColumn("correct", F.col("prediction") == F.col(label))
