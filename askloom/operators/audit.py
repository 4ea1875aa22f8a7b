"""Latency and audit reports, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.util import broadcast_if, global_rank, staged


def nearest_rank(rows: DataFrame, group: str, value: str, key: str, percents: dict[str, float]) -> DataFrame:
    """Exact percentiles by rounded nearest rank (half to even), per group, without gathering a group in one task."""
    ranked = global_rank(rows.select(group, value, key), [F.col(group), F.col(value), F.col(key)])
    sizes = staged(rows.groupBy(group).agg(F.count("*").alias("_n")), "sizes")
    first = ranked.groupBy(group).agg(F.min("rank").alias("_first"))
    at = {n: F.bround(p / 100.0 * (F.col("_n") - 1), 0).cast("bigint") + F.col("_first") for n, p in percents.items()}
    wanted = sizes.join(first, group).select(group, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in at]), F.array(*at.values()))).alias("name", "rank"))
    hit = ranked.join(broadcast_if(wanted, sizes, len(percents)), [group, "rank"])  # one row per group and percentile
    return hit.groupBy(group).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in at])


def interpolated(rows: DataFrame, group: str, value: str, key: str, percents: dict[str, float]) -> DataFrame:
    """Exact percentiles between neighbouring ranks, per group with a value; no group is gathered in one task.

    Nulls are left out. ``key`` tells apart the rows of a group, so that many equal values spread over tasks.
    """
    some = rows.select(group, value, key).filter(F.col(value).isNotNull())
    ranked = global_rank(some, [F.col(group), F.col(value), F.col(key)])
    sizes = staged(ranked.groupBy(group).agg(F.count("*").alias("_n"), F.min("rank").alias("_first")), "sizes")
    place = lambda p: F.lit(p / 100.0) * (F.col("_n") - 1)
    at = F.array(*[F.struct(F.lit(n).alias("name"), place(p).alias("place")) for n, p in percents.items()])
    asked = sizes.select(group, "_first", F.inline(at))
    share = F.col("place") - F.floor("place")
    ends = F.array(F.struct(F.floor("place").alias("off"), (1 - share).alias("weight")), F.struct((F.floor("place") + 1).alias("off"), share.alias("weight")))
    wanted = asked.select(group, "name", "_first", F.inline(ends)).filter("weight > 0").select(group, "name", "weight", (F.col("_first") + F.col("off")).alias("rank"))
    hit = ranked.join(broadcast_if(wanted, sizes, 2 * len(percents)), [group, "rank"])  # two rows per group and percentile
    return hit.groupBy(group).agg(*[F.sum(F.when(F.col("name") == n, F.col(value) * F.col("weight"))).alias(n) for n in percents])


def latency_bench(responses: DataFrame, key: str) -> DataFrame:
    """Per model: n, mean and nearest-rank percentiles, throughput, mean confidence and mean time per component.

    Throughput is responses per second of summed latency (one caller at a time). Component
    times come from the tool calls and count only where they are positive.
    """
    spent = lambda t: F.aggregate(F.filter("tool_calls", lambda c: c["tool_name"] == t), F.lit(0.0), lambda s, c: s + F.coalesce(c["latency_ms"], F.lit(0.0)))
    timed = responses.withColumns({"_ret": spent("SearchKB"), "_gen": spent("AnswerDirect")})
    means = timed.groupBy("model_tag").agg(
        F.count("*").alias("n_queries"), F.avg("latency_ms").alias("avg_latency_ms"), (F.count("*") / (F.sum("latency_ms") / 1000.0)).alias("throughput_qps"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(F.col("_ret") > 0, F.col("_ret"))), F.lit(0.0)).alias("avg_retrieval_ms"),
        F.coalesce(F.avg(F.when(F.col("_gen") > 0, F.col("_gen"))), F.lit(0.0)).alias("avg_generation_ms"))
    pct = nearest_rank(responses, "model_tag", "latency_ms", key, {"p50_latency_ms": 50, "p95_latency_ms": 95, "p99_latency_ms": 99})
    return means.join(pct, "model_tag")


def audit_stats(audit: DataFrame) -> DataFrame:
    """Counts, mean latency and confidence, escalations per tag and (tag null, is_total) in all, in one pass."""
    tag = F.coalesce(F.nullif("model_tag", F.lit("")), F.lit("unknown"))
    return audit.withColumn("tag", tag).rollup("tag").agg(
        F.grouping("tag").cast("int").alias("is_total"), F.count("*").alias("n"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.count_if(F.col("ticket_id").isNotNull() & (F.col("ticket_id") != "")).alias("escalations"))


def inverse_frequency_weights(rows: DataFrame, alpha: str, buckets: int = 5) -> DataFrame:
    """Adds ``weight`` = largest bucket count / own bucket count over equal-width buckets."""
    b = F.least(F.floor(F.col(alpha) * buckets), F.lit(buckets - 1)).cast("int")
    counts = rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n")).scalar()
    return rows.withColumn("bucket", b).join(F.broadcast(counts), "bucket").withColumn("weight", top / F.col("_n")).drop("_n")
