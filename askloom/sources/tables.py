"""Explicit schemas (nothing is inferred at read time) and table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askloom.util import settle

CITATION = (
    "struct<doc_id:string,chunk_id:string,span_start:int,span_end:int,cited_text:string,source:string,"
    "page_number:int,source_url:string,verified:boolean>"
)
TOOL_CALL = (
    "struct<tool_name:string,args:string,result:string,latency_ms:double,iteration:int,"
    "confidence_before:double,confidence_after:double>"
)
CHUNK = (
    "chunk_id string, doc_id string, text string, source string, page_number int, chunk_index int, token_count int, "
    "span_start int, span_end int, section_title string, domain string, metadata map<string,string>, created_at timestamp"
)
QA_PAIR = (
    "query string, answer_with_citations string, answer string, gold_chunk_ids array<string>, chunk_id string, "
    f"question_type string, type string, domain string, citations array<{CITATION}>, qa_id string"
)
TICKET = (
    "ticket_id string, session_id string, query string, summary string, category string, severity string, "
    "user_context string, evidence_gap string, estimated_response_time string, created_at timestamp"
)
AUDIT = (
    "timestamp timestamp, session_id string, model_tag string, query string, answer string, citations string, "
    "tool_calls string, confidence double, iterations int, fcrs double, latency_ms double, ttft_ms double, "
    "ticket_id string, decomposed boolean, verify_verdict string"
)
BLOCK_FIELDS = ("path", "block_idx", "page_number", "text", "_error")
BLOCK = "path string, block_idx int, page_number int, text string, _error string"

# Schemas of the test tables.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return settle(spark).read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
