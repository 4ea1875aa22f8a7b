"""Streaming queries over the event and document tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.operators import index
from askloom.plans.domain import sql_bm25_tokens
from askloom.plans.registry import query, relation
from askloom.sources import partitions
from askloom.sources.tables import table
from askloom.streaming import events as ev
from askloom.streaming import stateful
from askloom.util import scratch_dir


def replay(spark, sf, transform):
    """The events in five parts with restarts, so that watermarks move while the stream runs."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.replayed(e, "ts", transform)


#: the last watermark: an hour before the latest event
_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


def ntz(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("stream_audit_append", "SELECT event_id, ts, user_id::VARCHAR AS session_id, event_type AS model_tag, value AS latency_ms, CASE WHEN event_type = 'error' THEN 'TKT-' || event_id END AS ticket_id FROM events")
def stream_audit_append(spark, sf):
    out = scratch_dir(spark, "audit")
    s = ev.audit_stream(ev.event_stream(spark, sf))
    ev.run_append(s, out, scratch_dir(spark, "audit-state"))
    return spark.read.schema(s.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_AGG = "event_type AS model_tag, count(*) AS n, round(avg(value), 6) AS avg_latency_ms, count_if(event_type = 'error') AS escalations"


@query("stream_metrics", f"SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", {_AGG} FROM events GROUP BY ALL) WHERE \"end\" <= {_CLOSED}")
def stream_metrics(spark, sf):
    m = replay(spark, sf, lambda e: ev.windowed_metrics(ev.audit_stream(e), "1 day"))
    return m.select(ntz("start"), ntz("end"), "model_tag", "n", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "escalations")


@query("stream_metrics_sliding", f"""
    SELECT * FROM (SELECT start, start + INTERVAL 1 DAY AS "end", {_AGG} FROM (
      SELECT *, (time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (i * 6) HOUR)::TIMESTAMP AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)) GROUP BY ALL) WHERE "end" <= {_CLOSED}""")
def stream_metrics_sliding(spark, sf):
    m = replay(spark, sf, lambda e: ev.windowed_metrics(ev.audit_stream(e), "1 day", "6 hours"))
    return m.select(ntz("start"), ntz("end"), "model_tag", "n", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "escalations")


@query("stream_session_ttl", f"""
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS expires, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
        SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR, true))::INT AS fresh FROM events)) GROUP BY user_id, sid HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}""")
def stream_session_ttl(spark, sf):
    s = replay(spark, sf, ev.sessions)
    return s.select("user_id", ntz("start"), ntz("expires"), "n")


@query("stream_retention", "SELECT event_type AS model_tag, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY OR event_type = 'error' GROUP BY 1")
def stream_retention(spark, sf):
    """The audit stream fills a store by day; old rows are deleted from it, and the store is read again."""
    store = scratch_dir(spark, "audit")
    s = ev.audit_stream(ev.event_stream(spark, sf))
    ev.run_batches(s, ev.day_batch(store), scratch_dir(spark, "audit-state"))
    schema = s.select("*", F.to_date("ts").alias("day"), F.lit(0).cast("bigint").alias("batch")).schema
    ev.retain(spark, store, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").cast("timestamp"), schema, 10)
    kept = partitions.read_store(spark, store, schema)
    return kept.groupBy("model_tag").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("oldest"))


relation("fresh_docs", "SELECT DISTINCT text FROM documents")


@query("stream_ingest_incremental", f"""
    SELECT term, count(*) AS df, (SELECT count(*) FROM fresh_docs) AS n_chunks FROM (SELECT DISTINCT text, unnest({sql_bm25_tokens('text')}) AS term FROM fresh_docs) GROUP BY term""", ("fresh_docs",))
def stream_ingest_incremental(spark, sf):
    """Ingest the document stream twice (the second time from a new stream): nothing is stored twice; index refreshed."""
    store = scratch_dir(spark, "store")
    ev.ingest_stream(spark, sf, store, scratch_dir(spark, "ingest-state"))
    again = scratch_dir(spark, "ingest-state")
    ev.run_batches(ev.table_stream(spark, sf, "documents"), lambda df, i: ev.ingest_batch(store)(df, i + 1000), again)
    ix = index.load_segments(spark, f"{store}-index", "chunk_id")
    return ix.terms.select("term", "df", ix.totals.select("n_docs").scalar().alias("n_chunks"))


_CACHE_KEYS = "lower(trim(json_extract_string(props, '$.k'))) AS query, event_type AS model_tag"


@query("stream_dedup_queries", f"""
    WITH RECURSIVE r AS (SELECT {_CACHE_KEYS}, event_id AS id, ts FROM events),
    miss(query, model_tag, id, ts) AS (
      SELECT query, model_tag, first(id ORDER BY ts, id), min(ts) FROM r GROUP BY ALL
      UNION ALL
      SELECT m.query, m.model_tag, n.id, n.ts FROM miss m, LATERAL (
        SELECT r.id, r.ts FROM r WHERE r.query IS NOT DISTINCT FROM m.query AND r.model_tag = m.model_tag AND r.ts > m.ts + INTERVAL 1 DAY ORDER BY r.ts, r.id LIMIT 1) n),
    a AS (SELECT r.*, m.id AS answered_by FROM r ASOF JOIN miss m ON r.query = m.query AND r.model_tag = m.model_tag AND r.ts >= m.ts)
    SELECT query, model_tag, id, answered_by <> id AS hit, answered_by FROM a WHERE ts < {_CLOSED}""")
def stream_dedup_queries(spark, sf):
    """Requests over five parts that overlap in time: each one answered from the cache or computed."""
    e = table(spark, sf, "events").select(
        F.lower(F.trim(F.get_json_object("props", "$.k"))).alias("query"), F.col("event_type").alias("model_tag"), F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts")).withColumn("arrives", arrival("id"))
    told = ev.replayed(e, "arrives", lambda s: stateful.cached_stream(s, ["query", "model_tag"], ttl="1 day"))
    return told.select("query", "model_tag", "id", "hit", "answered_by")


def arrival(key: str):
    """Events arrive up to 30 minutes after their time, so they are out of order and parts overlap."""
    return F.col("ts") + F.make_dt_interval(mins=F.pmod(F.hash(key), F.lit(30)))


@query("stream_resume", "SELECT event_type AS model_tag, count(*) AS n FROM events GROUP BY 1")
def stream_resume(spark, sf):
    """The same query started twice on one checkpoint: the second run finds nothing new."""
    out, state = scratch_dir(spark, "labels"), scratch_dir(spark, "labels-state")
    for _ in range(2):
        s = ev.audit_stream(ev.event_stream(spark, sf))
        ev.run_append(s, out, state)
    return spark.read.schema(s.schema).parquet(out).groupBy("model_tag").agg(F.count("*").alias("n"))


#: an event is the first of a response when the one before it was ``done`` or more than six hours earlier
_RESPONSES = """
    SELECT *, row_number() OVER (PARTITION BY user_id, response ORDER BY ts, event_id) AS sequence FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS response FROM (
        SELECT *, (coalesce(lag(event_type) OVER w = 'error' OR ts - lag(ts) OVER w > INTERVAL 6 HOUR, true))::INT AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query("stream_answer_assembly", f"""
    SELECT user_id, response, coalesce(string_agg(event_id || ' ', '' ORDER BY sequence) FILTER (WHERE event_type = 'view'), '') AS answer,
           coalesce(list(event_id || ' ' ORDER BY sequence) FILTER (WHERE event_type = 'click'), []) AS citations,
           arg_max(event_id || ' ', sequence) FILTER (WHERE event_type = 'purchase') AS verdict, bool_or(event_type = 'error') AS finished,
           round((epoch_us(min(ts) FILTER (WHERE event_type = 'view')) - epoch_us(min(ts))) / 1000, 3) AS ttft_ms, count(*) AS n_events
    FROM ({_RESPONSES}) GROUP BY user_id, response HAVING bool_or(event_type = 'error') OR max(ts) + INTERVAL 6 HOUR < {_CLOSED}""")
def stream_answer_assembly(spark, sf):
    """A user's events as the events of responses, arriving out of order over five parts with restarts."""
    ty, by = F.col("event_type"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(ty == "view", "token").when(ty == "click", "citation").when(ty == "purchase", "verify").when(ty == "error", "done").otherwise("meta")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before = F.lag("event_type").over(by)
    fresh = F.coalesce((before == "error") | (F.col("ts") - F.lag("ts").over(by) > F.expr("INTERVAL '6' HOUR")), F.lit(True))
    e = e.withColumn("response", F.sum(fresh.cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("sequence", F.row_number().over(Window.partitionBy("user_id", "response").orderBy("ts", "event_id")))
    rows = e.select("user_id", "response", kind.alias("kind"), "sequence", "ts", F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("payload"), arrival("event_id").alias("arrives"))
    told = ev.replayed(rows, "arrives", lambda s: stateful.assembled_stream(s, ["user_id", "response"]))
    return told.withColumn("ttft_ms", F.round("ttft_ms", 3))
