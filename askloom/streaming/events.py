"""Structured Streaming over an event table: append, running totals, sessions, incremental ingest, resume.

Each runner starts a query with ``availableNow``, waits for it, stops it, and gives back
what the sink holds as a batch DataFrame. State and sinks live in the shared folder.
Windows and sessions are in append mode: they come out when the watermark closes them, and
rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.operators.index import write_segment
from askloom.sources import partitions
from askloom.sources.records import short_hash
from askloom.sources.tables import TABLES
from askloom.util import scratch_dir, settle


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files.

    The name is a pattern because Spark takes a plain path of a stream for a folder.
    """
    return settle(spark).readStream.schema(TABLES[name]).parquet(f"{folder}/{name}.parque[t]")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as an event-time column (the files hold time-zone-free stamps)."""
    return table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    try:
        q.awaitTermination()
    finally:
        q.stop()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def time_bounds(rows: DataFrame, time: str, parts: int) -> list:
    """Values that cut a table's time column into ``parts`` parts of about equal size."""
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), shares, 1000)).first()[0] or []
    return [F.timestamp_micros(F.lit(x)) for x in sorted(set(found))]


def replayed(rows: DataFrame, time: str, transform: Callable[[DataFrame], DataFrame], bounds: list | None = None, parts: int = 5) -> DataFrame:
    """What a stream makes of a table that arrives in parts, one after the other, with a restart in between.

    The parts are cut at ``bounds`` of the time column (default: ``parts`` of equal size). A
    part is added to the source folder, in as many files as Spark makes, and the query runs
    on the same checkpoint until it has taken it in; watermark and state carry over.
    """
    spark = settle(rows.sparkSession)
    folder, out, state = (scratch_dir(spark, name) for name in ("replay", "stream-result", "stream-state"))
    bounds = time_bounds(rows, time, parts) if bounds is None else bounds
    edges, schema = [None, *bounds, None], None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = rows if lo is None else rows.filter(F.col(time) >= lo)
        part = part if hi is None else part.filter(F.col(time) < hi)
        part.write.parquet(f"{folder}/part={i}")
        source = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(folder)
        stream = transform(source)
        schema = stream.schema
        run_append(stream, out, state)
    return spark.read.schema(schema).parquet(out)


def audit_stream(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id"), F.col("ts"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("model_tag"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("TKT-"), F.col("event_id").cast("string"))).alias("ticket_id"))


def windowed_metrics(audit: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts, mean latency and escalations per time window and tag."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return audit.withWatermark("ts", delay).groupBy(w.alias("w"), "model_tag").agg(
        F.count("*").alias("n"), F.avg("latency_ms").alias("avg_latency_ms"), F.count("ticket_id").alias("escalations")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model_tag", "n", "avg_latency_ms", "escalations")


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """A user's activity cut where nothing happens for ``gap``: the session expires then."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("expires"), "n")


#: folders of a store that a stream fills: a replayed micro-batch replaces its own files
DAY_FOLDERS = ["day", "batch"]


def day_batch(path: str, time: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer into folders by day and micro-batch."""
    def write(df: DataFrame, batch_id: int) -> None:
        partitions.write_partitions(df.withColumn("day", F.to_date(time)).withColumn("batch", F.lit(batch_id).cast("bigint")), path, DAY_FOLDERS)

    return write


def retain(spark: SparkSession, path: str, now: Column, schema, days: int = 30, time: str = "ts") -> None:
    """Delete rows older than ``days`` that carry no ticket from a store that ``day_batch`` filled.

    Only folders of days that had begun by then are read, and of these only the ones that
    lose rows are rewritten.
    """
    limit = now - F.make_interval(days=F.lit(days))
    ticket = F.col("ticket_id").isNotNull() & (F.col("ticket_id") != "")
    partitions.delete_where(spark, path, DAY_FOLDERS, F.col("day") <= F.to_date(limit), (F.col(time) >= limit) | ticket, schema)


def ingest_batch(store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: new chunks only, one folder and one index segment per batch id, so a replayed batch overwrites itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        fresh = df.select(short_hash("text").alias("chunk_id"), "text").groupBy("chunk_id").agg(F.first("text").alias("text"))
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(store)
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            known = spark.read.schema("chunk_id string, text string, batch bigint").parquet(store)
            fresh = fresh.join(known.filter(F.col("batch") != batch_id).select("chunk_id"), "chunk_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        stored = spark.read.schema("chunk_id string, text string").parquet(f"{store}/batch={batch_id}")
        write_segment(stored, f"{store}-index", batch_id, "chunk_id")

    return write


def ingest_stream(spark: SparkSession, folder: str, store: str, checkpoint: str) -> DataFrame:
    """Stream documents into the chunk store and give the store back."""
    run_batches(table_stream(spark, folder, "documents"), ingest_batch(store), checkpoint)
    return spark.read.schema("chunk_id string, text string, batch bigint").parquet(store)
