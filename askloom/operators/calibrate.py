"""Calibration: ECE, reliability bins, temperature, AUROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import maths
from askloom.util import global_rank


def bin_index(confidence, bins: int = 10) -> Column:
    """Equal-width bin of a confidence; edges are i * (1 / bins) as doubles and the last bin is closed."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.least(sum((F.when(c >= i * (1.0 / bins), 1).otherwise(0) for i in range(1, bins + 1)), F.lit(0)), F.lit(bins - 1))


def binned(rows: DataFrame, group: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    return rows.groupBy(*group, bin_index(confidence, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(correct).alias("accuracy"), F.avg(confidence).alias("confidence"))


def ece(rows: DataFrame, group: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    b = binned(rows, group, confidence, correct, bins)
    return b.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def reliability_bins(rows: DataFrame, group: str, confidence: str, quality: str, good: float = 0.70, minimum: int = 10, bins: int = 10) -> DataFrame:
    """All bins per model, empty ones included; models with fewer than ``minimum`` rows are left out."""
    live = rows.filter(F.col(confidence).isNotNull() & F.col(quality).isNotNull()).withColumn("_ok", F.when(F.col(quality) >= good, 1.0).otherwise(0.0))
    b = binned(live, [group], confidence, "_ok", bins)
    models = b.groupBy(group).agg(F.sum("n").alias("t")).filter(F.col("t") >= minimum)
    frame = models.select(group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(b, [group, "bin"], "left").select(
        group, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _best_temperature(rows: DataFrame, group: list[str], loss, t_min: float, t_max: float, steps: int) -> DataFrame:
    """First grid temperature with the least mean loss; one pass over the rows, sums combine before the shuffle."""
    width = (t_max - t_min) / (steps - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.round(t_min + i * width, 6))).alias("t")
    scored = rows.select("*", grid).groupBy(*group, "t").agg(F.round(F.avg(loss(F.col("t"))), 9).alias("loss"))
    return scored.groupBy(*group).agg(F.min_by("t", F.struct("loss", "t")).alias("temperature"), F.min("loss").alias("loss"))


def temperature_binary(rows: DataFrame, group: list[str], logit: str, label: str, t_min: float = 0.5, t_max: float = 3.0, steps: int = 51) -> DataFrame:
    y, z = F.col(label), F.col(logit)
    return _best_temperature(rows, group, lambda t: y * maths.log1p_exp(-z / t) + (1 - y) * maths.log1p_exp(z / t), t_min, t_max, steps)


def temperature_multiclass(rows: DataFrame, group: list[str], logits: str, label: str, t_min: float = 0.5, t_max: float = 3.0, steps: int = 51) -> DataFrame:
    """``label`` is the index of the right class in the ``logits`` array."""
    def loss(t):
        top = F.array_max(logits) / t
        total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x / t - top))
        return -(F.get(logits, F.col(label)) / t - top - F.log(total))

    return _best_temperature(rows, group, loss, t_min, t_max, steps)


def temperature_mse(rows: DataFrame, group: list[str], logit: str, label: str, t_min: float = 0.5, t_max: float = 3.0, steps: int = 26) -> DataFrame:
    return _best_temperature(rows, group, lambda t: F.pow(maths.sigmoid(logit, t) - F.col(label), 2), t_min, t_max, steps)


def auroc(rows: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Mann-Whitney AUROC on ordinal ranks (ties ordered by key); null with one class only."""
    ranked = global_rank(rows.select(score, label, key), [F.col(score), F.col(key)])
    pos = F.col(label) >= 0.5
    n_pos, n_neg = F.count_if(pos), F.count_if(~pos)
    u = F.sum(F.when(pos, F.col("rank")).otherwise(0)) - n_pos * (n_pos + 1) / 2
    return ranked.agg(F.try_divide(u.cast("double"), n_pos * n_neg).alias("auroc"))


def calibration_report(rows: DataFrame, score: str, label: str, key: str, tag: str = "model") -> DataFrame:
    """n, temperature, ECE before and after scaling, AUROC."""
    base = rows.select(F.lit(tag).alias("model_tag"), F.col(key), F.col(score), F.col(label), maths.logit(F.col(score)).alias("_z"),
                       F.when(F.col(label) >= 0.5, 1.0).otherwise(0.0).alias("_y"))
    t = temperature_binary(base, ["model_tag"], "_z", "_y").select("temperature").scalar()
    scaled = base.withColumn("_s", maths.sigmoid("_z", t))
    before, after = ece(base, ["model_tag"], score, "_y"), ece(scaled, ["model_tag"], "_s", "_y")
    return (
        base.groupBy("model_tag").agg(F.count("*").alias("n")).withColumn("temperature", t)
        .join(before.withColumnRenamed("ece", "ece_before"), "model_tag").join(after.withColumnRenamed("ece", "ece_after"), "model_tag")
        .withColumn("auroc", auroc(base, score, "_y", key).scalar()))


__all__ = ["auroc", "bin_index", "binned", "calibration_report", "ece", "reliability_bins", "temperature_binary", "temperature_mse", "temperature_multiclass"]
