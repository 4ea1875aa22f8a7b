"""Sources, sinks and stores. Files are written from the given tables into the shared folder first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import index, retrieve
from askloom.plans import domain as d
from askloom.plans.domain import sql_strip
from askloom.plans.registry import query, relation
from askloom.sources import files, partitions, records, stores, tables
from askloom.sources.tables import table
from askloom.util import scratch_dir

SOLID = r"length(regexp_replace(text, '\s', '', 'g'))"


def text_files(spark, sf) -> str:
    """Documents as text files, a folder per source; files are bounded in rows, so a huge source is many files."""
    path = scratch_dir(spark, "texts")
    d.corpus(spark, sf).select("source", F.col("text").alias("value")).write.option("maxRecordsPerFile", 2000).partitionBy("source").text(path)
    return path


def source_of(path="path"):
    return F.url_decode(F.regexp_extract(path, r"source=([^/]+)/", 1))


def solid(c):
    return F.length(F.regexp_replace(c, r"\s", "")).cast("bigint")


@query("src_discover_files", "SELECT DISTINCT source FROM documents")
def src_discover_files(spark, sf):
    found = files.discover_files(files.binary_files(spark, text_files(spark, sf)), (".TXT",))
    return found.select(source_of().alias("source")).distinct()


@query("src_text_blocks", f"SELECT source, sum({SOLID})::BIGINT AS n_solid FROM documents GROUP BY source")
def src_text_blocks(spark, sf):
    blocks = files.text_blocks(files.binary_files(spark, text_files(spark, sf)))
    return blocks.groupBy(source_of().alias("source")).agg(F.sum(solid("text")).alias("n_solid"))


@query("src_blocks_pluggable", rf"""
    SELECT source, count_if({sql_strip('line')} <> '')::BIGINT AS n_blocks, sum(length(regexp_replace(line, '\s', '', 'g')))::BIGINT AS n_solid, 0 AS n_errors
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def src_blocks_pluggable(spark, sf):
    def lines(content: bytes, path: str):
        for line in content.decode("utf-8", "replace").split("\n"):
            yield {"text": line, "page_number": None}

    blocks = files.parsed_blocks(files.binary_files(spark, text_files(spark, sf)), {".txt": lines})
    return blocks.groupBy(source_of().alias("source")).agg(
        F.count("text").alias("n_blocks"), F.sum(solid("text")).alias("n_solid"), F.count("_error").cast("int").alias("n_errors"))


@query("flatten_table", r"""
    SELECT p_partkey, '[TABLE]' || chr(10) || p_name || chr(9) || p_brand || chr(10) || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '' END || chr(9) || p_type AS flat FROM part""")
def flatten_table(spark, sf):
    cells = F.array(F.array(F.concat(F.lit("  "), "p_name"), F.concat("p_brand", F.lit(" "))),
                    F.array(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", tx.flatten_cells(cells).alias("flat"))


NAMES = (".pdf", ".DOCX", ".exe", ".txt", "", ".md")


@query("admit_uploads", rf"""
    SELECT page_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 26214400 THEN 'exceeds 26214400 bytes'
                         WHEN page_id % 6 IN (2, 4) THEN 'unsupported type' END AS reject_reason,
           CASE WHEN size > 0 AND size <= 26214400 AND page_id % 6 NOT IN (2, 4)
                THEN substr(regexp_replace(slug, '[^\p{{L}}\p{{N}}_\-]', '', 'g'), 1, 64) || lower({d.sql_list(NAMES)}[page_id % 6 + 1]) END AS stored_name
    FROM (SELECT page_id, regexp_replace(url, '[./]', ' ', 'g') AS slug,
                 CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN length(html) * 100000 ELSE length(html) END AS size FROM pages)""")
def admit_uploads(spark, sf):
    size = F.length("html").cast("bigint")
    up = table(spark, sf, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", "[./]", " "), F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("page_id") % 6).cast("int"))).alias("path"),
        F.when(F.col("page_id") % 7 == 0, 0).when(F.col("page_id") % 7 == 1, size * 100000).otherwise(size).alias("length"))
    return files.admit_uploads(up).select("page_id", "reject_reason", "stored_name")


@query("src_jsonl", "SELECT conv_id, turn, role, text FROM conversations WHERE turn <> 3")
def src_jsonl(spark, sf):
    path = scratch_dir(spark, "jsonl")
    c = table(spark, sf, "conversations")
    good = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    c.select(F.when(F.col("turn") == 3, F.concat(F.lit('{"conv_id": broken '), "role")).otherwise(F.concat(good, F.when(F.col("turn") == 2, "\n\n").otherwise(""))).alias("value")).write.text(path)
    return records.read_jsonl(spark, path, tables.TABLES["conversations"])


@query("coalesce_aliases", """
    SELECT qa_id, CASE WHEN v % 3 = 0 THEN answer WHEN v % 3 = 1 THEN chunk ELSE query END AS answer, CASE WHEN v < 3 THEN qtype ELSE 'factoid' END AS question_type FROM qa""", ("qa",))
def coalesce_aliases(spark, sf):
    v = F.col("v")
    r = d.qa(spark, sf).select(
        "qa_id", F.when(v % 3 == 0, F.col("answer")).otherwise("").alias("answer_with_citations"), F.when(v % 3 <= 1, F.col("chunk")).alias("answer"),
        F.col("query").alias("legacy"), F.when(v < 3, F.col("qtype")).alias("question_type"), F.lit("factoid").alias("type"))
    return r.select("qa_id", records.first_present("answer_with_citations", "answer", "legacy").alias("answer"), records.first_present("question_type", "type").alias("question_type"))


@query("sink_jsonl", "SELECT role, 2 * count(*) AS appended, count(*) AS overwritten, 2 * sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def sink_jsonl(spark, sf):
    c, a, o = table(spark, sf, "conversations"), scratch_dir(spark, "append"), scratch_dir(spark, "over")
    for _ in range(2):
        records.write_jsonl(c, a)
        records.write_jsonl(c, o, append=False)
    schema = tables.TABLES["conversations"]
    app = records.read_jsonl(spark, a, schema).groupBy("role").agg(F.count("*").alias("appended"), F.sum(F.length("text")).alias("chars"))
    return app.join(records.read_jsonl(spark, o, schema).groupBy("role").agg(F.count("*").alias("overwritten")), "role")


@query("upsert_chunks", """
    SELECT event_type AS collection, user_id AS chunk_id, arg_max(props, event_id) AS text, max(event_id) AS created_at FROM events GROUP BY ALL""")
def upsert_chunks(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("collection"), F.col("user_id").alias("chunk_id"), F.col("props").alias("text"), F.col("event_id").alias("created_at"), "ts")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    merged = stores.upsert(rows.filter(F.col("ts") < half).drop("ts"), rows.filter(F.col("ts") >= half).drop("ts"), ["collection", "chunk_id"], ["created_at"])
    path = scratch_dir(spark, "collections")
    stores.write_collections(merged, path)
    stores.write_collections(merged.filter("collection = 'view'"), path)  # replaces that collection only
    return spark.read.schema("chunk_id bigint, text string, created_at bigint, collection string").parquet(path)


relation("uniq", "SELECT DISTINCT text FROM documents")


@query("append_index", f"""
    SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * avg(r) OVER () ELSE r END, 6) AS idf FROM (
      SELECT term, df, ln((SELECT count(*) FROM uniq) - df + 0.5) - ln(df + 0.5) AS r FROM (
        SELECT term, count(*) AS df FROM (SELECT DISTINCT text, unnest({d.sql_bm25_tokens('text')}) AS term FROM uniq) GROUP BY term))""", ("uniq",))
def append_index(spark, sf):
    docs = d.corpus(spark, sf).select(records.short_hash("text").alias("chunk_id"), "text", "doc_id")
    labelled = table(spark, sf, "labels").select("doc_id")
    current = docs.join(labelled, "doc_id", "left_semi").groupBy("chunk_id").agg(F.first("text").alias("text"))
    path = scratch_dir(spark, "index")
    index.save_index(index.build_index(current, "chunk_id"), path)
    fresh = stores.unseen(current, docs.select("chunk_id", "text"), "chunk_id")
    return index.extend(index.load_index(spark, path, "chunk_id", "string"), fresh).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("save_load_index", "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 5", ("bm25",))
def save_load_index(spark, sf):
    path = scratch_dir(spark, "index")
    index.save_index(d.lexical(spark, sf), path)
    return retrieve.bm25_topk(d.queries(spark, sf), index.load_index(spark, path, "doc_id"), 5).select("query_id", "doc_id", "score", "rank")


@query("collection_stats", "SELECT source AS collection, count(*) AS n_chunks FROM documents GROUP BY source")
def collection_stats(spark, sf):
    return stores.collection_stats(d.corpus(spark, sf).withColumnRenamed("source", "collection"))


@query("purge_stale_collections", """
    SELECT collection, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'main_' ELSE 'user_' END || user_id AS collection, ts, value FROM events)
    GROUP BY collection HAVING NOT (collection LIKE 'user_%' AND max(value) < 60 AND max(ts) < TIMESTAMP '2024-01-30 10:00:00')""")
def purge_stale_collections(spark, sf):
    chunks = table(spark, sf, "events").select(F.concat(F.when(F.col("event_type") == "view", "main_").otherwise("user_"), F.col("user_id").cast("string")).alias("collection"), "ts", "value")
    seen = chunks.groupBy("collection").agg(F.when(F.max("value") < 60, F.max("ts")).alias("created_at"))
    path = scratch_dir(spark, "collections")
    schema = stores.bucketed(chunks).schema
    stores.write_bucketed(chunks, path)
    stores.purge_stale_bucketed(spark, path, seen, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), schema)
    kept = partitions.read_store(spark, path, schema)
    return kept.groupBy("collection").agg(F.count("*").alias("n"))


@query("reembed_collection", """
    SELECT doc_id AS chunk_id, [length(text), length(text) - length(replace(text, 'e', ''))]::FLOAT[] AS embedding, 'v2' AS collection FROM documents""")
def reembed_collection(spark, sf):
    def encoder(texts: pd.Series) -> list:
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    return stores.reembed(d.corpus(spark, sf).withColumnRenamed("doc_id", "chunk_id"), encoder, "v2")


@query("flatten_metadata", """
    SELECT doc_id, MAP {'meta_lang': lang, 'meta_source': source} AS flat, MAP {'lang': lang, 'source': source} AS restored FROM documents""")
def flatten_metadata(spark, sf):
    m = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("tags"), F.to_json(F.array("lang", "source")), F.lit("nested"), F.to_json(F.struct("lang")), F.lit("none"), F.lit(None).cast("string"))
    flat = d.corpus(spark, sf).select("doc_id", records.flatten_metadata(m).alias("flat"))
    return flat.select("doc_id", "flat", records.restore_metadata(F.map_concat("flat", F.create_map(F.lit("chunk_index"), F.lit("0")))).alias("restored"))


@query("audit_append", """
    SELECT event_type AS model_tag, ts::DATE AS day, count(*) AS n, round(sum(value), 6) AS latency, count(*) * 2 AS n_citations, count_if(event_type = 'error') AS n_tickets
    FROM events GROUP BY ALL""")
def audit_append(spark, sf):
    e = table(spark, sf, "events")
    cite = F.struct(F.col("event_id").cast("string").alias("doc_id"), F.lit(0).alias("span_start"))
    resp = e.select(
        F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("model_tag"), F.col("value").alias("latency_ms"),
        F.array(cite, cite).alias("citations"), F.array(F.struct(F.lit("SearchKB").alias("tool_name"))).alias("tool_calls"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("TKT-"), F.col("event_id").cast("string"))).alias("ticket_id"))
    path = scratch_dir(spark, "audit")
    records.append_audit(resp, path)
    back = spark.read.schema("timestamp timestamp_ntz, session_id string, model_tag string, latency_ms double, citations string, tool_calls string, ticket_id string, day date").parquet(path)
    n_cites = F.size(F.from_json("citations", "array<struct<doc_id:string,span_start:int>>"))
    return back.groupBy("model_tag", "day").agg(
        F.count("*").alias("n"), F.round(F.sum("latency_ms"), 6).alias("latency"), F.sum(n_cites).alias("n_citations"), F.count("ticket_id").alias("n_tickets"))


@query("ticket_upsert", """
    SELECT 'TKT-' || upper(substr(sha256(user_id::VARCHAR), 1, 10)) AS ticket_id, user_id::VARCHAR AS session_id, arg_max(value, event_id) AS value, max(event_id) AS seq
    FROM events WHERE event_type = 'error' GROUP BY user_id""")
def ticket_upsert(spark, sf):
    t = table(spark, sf, "events").filter("event_type = 'error'").select(
        records.ticket_id_of(F.col("user_id").cast("string")).alias("ticket_id"), F.col("user_id").cast("string").alias("session_id"), "value", F.col("event_id").alias("seq"))
    return stores.last_write_wins(t, ["ticket_id"], ["seq"])


@query("results_sideload", """
    SELECT event_type AS model_tag, coalesce(detail, total) AS latency, detail IS NOT NULL AS has_detail, coalesce(n, 0) AS n_rows
    FROM (SELECT event_type, round(avg(value), 6) AS total FROM events GROUP BY 1)
    LEFT JOIN (SELECT event_type, round(avg(v), 6) AS detail, count(*) AS n FROM (SELECT event_type, user_id, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) GROUP BY 1) USING (event_type)""")
def results_sideload(spark, sf):
    from askloom.operators.evaluate import sideload
    e = table(spark, sf, "events").select(F.col("event_type").alias("model_tag"), "user_id", "value")
    summary = e.groupBy("model_tag").agg(F.round(F.avg("value"), 6).alias("latency"))
    detail = e.filter(F.col("model_tag").isin("click", "view")).groupBy("model_tag", "user_id").agg(F.avg("value").alias("v"))
    per = detail.groupBy("model_tag").agg(F.round(F.avg("v"), 6).alias("latency"), F.count("*").alias("n_rows"))
    return sideload(summary, per)
