"""Helpers shared by operators: size-checked broadcasts, lineage cuts, scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_LIMIT = 32 * 1024 * 1024
#: bytes of rows that travel to a Python worker at once; Spark's own limit is 64 MB for each core
BATCH_BYTES = 8 * 1024 * 1024


def settle(spark: SparkSession) -> SparkSession:
    """Switch off a Spark 4.1 setting that gives wrong groups and bound Arrow batches by bytes, once per session.

    With ``spark.sql.unionOutputPartitioning`` a union of two inputs placed by the same key
    counts as placed by it, and the shuffle after it is dropped; when AQE merges the two
    inputs' partitions differently, rows of one key then meet in different tasks. Seen as
    results that changed from run to run; ``tests/test_engine.py`` keeps watch. Batches hold
    ``BATCH_BYTES`` or one row, so a worker's memory does not follow the texts' length.
    """
    if getattr(spark, "_askloom_settled", False) is False:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark._askloom_settled = True
    return spark


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan in bytes; None where it cannot be asked."""
    settle(df.sparkSession)
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return None
    return int(str(jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(basis: DataFrame, factor: int = 1, limit: int = BROADCAST_LIMIT) -> bool:
    """True when ``basis`` (times ``factor`` rows per row) is known to stay under ``limit``."""
    size = planned_bytes(basis)
    return size is not None and size * factor <= limit


def broadcast_if(df: DataFrame, basis: DataFrame | None = None, factor: int = 1) -> DataFrame:
    """Broadcast ``df`` only when the relation that bounds its size is small.

    ``basis`` is a relation whose row count bounds ``df`` up to ``factor``. Beyond the
    limit the frame is returned unhinted, and Spark joins by shuffle with AQE skew splitting.
    """
    return F.broadcast(df) if fits(df if basis is None else basis, factor) else df


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark prunes to k per task before the shuffle."""
    settle(df.sparkSession)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only on a local master.

    On a cluster a folder of one machine would hold a part of each table, so there it is an
    error not to name a shared one.
    """
    sc = settle(spark).sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder, for stream state and staged tables."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that iterative plans do not grow.

    A written table rather than ``checkpoint()``: it survives lost executors just as well
    and computes the plan once, where an eager checkpoint computes it twice.
    """
    return staged(df, "round")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with its schema.

    Used where two or more branches of one plan consume a costly intermediate result.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place rows by key over all shuffle partitions.

    The number is given explicitly so that AQE does not merge partitions by their size in
    bytes: the work that follows (tokenising, matching) is heavy per byte.
    """
    return df.repartition(int(settle(df.sparkSession).conf.get("spark.sql.shuffle.partitions")), *keys)


def balanced(df: DataFrame, limit: int = 8 * BROADCAST_LIMIT) -> DataFrame:
    """Spread a small scan over all partitions; leave a large one as it is.

    A small table is read by few tasks whatever the cores, and text work is heavy per byte.
    A large one already comes in many splits, and shuffling it would cost more than it gives.
    """
    return spread(df) if fits(df, limit=limit) else df


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based position in a total order, without sorting everything in one task.

    Rows are placed by range and written once (range bounds come from a sample, so a second
    evaluation could cut differently); each range is ranked by itself and shifted by the
    number of rows before it. Only one count per range is brought together. End the order
    with a unique column.
    """
    spark = settle(df.sparkSession)
    names = [f"_o{i}" for i in range(len(order))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns(dict(zip(names, order))).repartitionByRange(n, *names).withColumn("_pid", F.spark_partition_id())
    placed = staged(placed, "ranges")
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*names))
    ranked = placed.join(F.broadcast(starts), "_pid")  # at most one row per partition
    return ranked.withColumn(rank, F.col("_start") + local).drop("_pid", "_start", *names)
