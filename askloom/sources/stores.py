"""Chunk collections and tickets as plain tables: upsert, append, purge, re-embed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.sources import partitions
from askloom.util import staged


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns.

    An aggregate, not a window: rows of a key that was rewritten very often are
    combined before the shuffle instead of meeting in one task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    ordered = F.struct(*order, *rest) if rest else F.struct(*order)
    best = rows.groupBy(*keys).agg(F.max_by(ordered, F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in order + rest]).select(*rows.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_write_wins(current.unionByName(incoming), keys, order)


def write_collections(chunks: DataFrame, path: str) -> None:
    """Replace only the collections present in ``chunks``."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def append_unseen(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Union of the current rows and those incoming rows whose key is new (first incoming one per key)."""
    return current.unionByName(unseen(current, incoming, key))


def unseen(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is new, one per key."""
    return incoming.dropDuplicates([key]).join(current.select(key), key, "left_anti")


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("n_chunks"))


def stale_collections(collections: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """``user_*`` collections older than ``hours``; an unknown age is kept."""
    age_limit = now - F.make_interval(hours=F.lit(hours))
    return collections.filter(F.startswith("collection", F.lit("user_")) & (F.col("created_at") < age_limit))


def purge_stale(spark, path: str, collections: DataFrame, now: Column, schema, hours: int = 2) -> None:
    """Drop the stale collections' folders from a store partitioned by collection; no other file is touched."""
    partitions.delete_where(spark, path, ["collection"], stale_collections(collections, now, hours).select("collection"), F.lit(False), schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("collection"), F.lit(buckets)).cast("int").alias("bucket")


def bucketed(chunks: DataFrame, buckets: int = 64) -> DataFrame:
    """Chunks with the folder that a store of very many collections keeps them in: a folder per bucket, not per collection."""
    return chunks.withColumn("bucket", _bucket(buckets))


def write_bucketed(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """A store whose number of folders and files does not grow with the number of collections; large buckets are split."""
    partitions.write_partitions(bucketed(chunks, buckets).hint("rebalance", F.col("bucket")), path, ["bucket"])


def purge_stale_bucketed(spark, path: str, collections: DataFrame, now: Column, schema, hours: int = 2, buckets: int = 64) -> None:
    """Delete the stale collections' rows from a store that ``write_bucketed`` filled; buckets without any are not touched.

    ``schema`` is that of ``bucketed`` chunks; ``buckets`` must be the number the store was written with.
    """
    stale = staged(stale_collections(collections, now, hours).select("collection").distinct(), "stale")
    partitions.delete_where(spark, path, ["bucket"], stale.select(_bucket(buckets)), stale, schema)


def reembed(chunks: DataFrame, encoder: Callable[[pd.Series], list], name: str) -> DataFrame:
    """Re-encode all texts of a collection into a new one; the old one stays."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": list(encoder(pdf["text"]))})

    cid = dict(chunks.dtypes)["chunk_id"]
    vectors = chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {cid}, embedding array<float>")
    return vectors.withColumn("collection", F.lit(name))


def severity_sla(severity) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    m = F.create_map(*[F.lit(x) for kv in fixed.SEVERITY_SLA.items() for x in kv])
    return F.coalesce(F.try_element_at(m, s), F.lit(fixed.SEVERITY_SLA["medium"]))


def valid_severity(severity) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s.isin(*fixed.SEVERITY_SLA), s).otherwise(F.lit("medium"))


def valid_category(category) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    return F.when(c.isin(*fixed.TICKET_CATEGORIES), c).otherwise(F.lit("other"))


def list_tickets(audit: DataFrame, time: str = "timestamp", tie: str = "session_id") -> DataFrame:
    """Rows with a ticket, newest first."""
    return audit.filter(F.col("ticket_id").isNotNull() & (F.col("ticket_id") != "")).orderBy(F.desc(time), F.asc(tie))
