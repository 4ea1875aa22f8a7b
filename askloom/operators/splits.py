"""Samples and splits with a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions.maths import hash_order
from askloom.util import broadcast_if, global_rank


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded order (the sampling operator itself; Spark takes n per task first)."""
    return rows.orderBy(hash_order(key, seed), F.col(key)).limit(n)


def split_exact(rows: DataFrame, key: str, dataset: str, ratios: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 42,
                names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Adds ``split`` with exact counts per dataset: floors, the rest to the last part; with three or more rows
    every later part with a positive ratio gets one at least."""
    if any(r < 0 for r in ratios) or not 0.999 <= sum(ratios) <= 1.001 or len(ratios) != len(names):
        raise ValueError("ratios must be non-negative, sum to 1 and match the names")
    ranked = global_rank(rows.withColumn("_h", hash_order(key, seed)), [F.col(dataset), F.col("_h"), F.col(key)], "_r")
    sizes = ranked.groupBy(dataset).agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    n = F.col("_n")
    counts = [F.floor(n * r) for r in ratios[:-1]]
    counts.append(n - sum(counts[1:], counts[0]))
    for i in range(1, len(ratios)):
        if ratios[i] > 0:
            lacking = (n >= 3) & (counts[i] == 0)
            counts[0] = F.when(lacking, F.greatest(counts[0] - 1, F.lit(0))).otherwise(counts[0])
            counts[i] = F.when(lacking, 1).otherwise(counts[i])
    pos = F.col("_r") - F.col("_first")
    joined = ranked.join(broadcast_if(sizes), dataset)
    upto, split = F.lit(0), F.lit(names[-1])
    bounds = []
    for c in counts[:-1]:
        upto = upto + c
        bounds.append(upto)
    for name, bound in reversed(list(zip(names, bounds))):
        split = F.when(pos < bound, name).otherwise(split)
    return joined.withColumn("split", split).drop("_h", "_r", "_n", "_first")


def split_manifest(split: DataFrame, dataset: str, seed: int, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    counts = split.groupBy(dataset).pivot("split", list(names)).count().na.fill(0)
    return counts.withColumns({"total": sum((F.col(n) for n in names), F.lit(0)), "seed": F.lit(seed)})
