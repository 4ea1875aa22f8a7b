"""JSON-lines records in and out, field aliases, ids, metadata, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, array_file: bool = False) -> DataFrame:
    """JSON lines under a fixed schema; blank and malformed lines are skipped.

    ``array_file`` reads one JSON array per file instead.
    """
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", array_file).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def first_present(*cols) -> Column:
    """First field that is neither null nor an empty string (legacy field names by priority)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cs])


def short_hash(c) -> Column:
    """First 16 hex characters of SHA-256."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.sha2(c, 256), 1, 16)


def doc_id_of(source) -> Column:
    return short_hash(source)


def chunk_id_of(doc_id, index) -> Column:
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    i = F.col(index) if isinstance(index, str) else index
    return short_hash(F.concat(d, F.lit("::chunk::"), i.cast("string")))


def ticket_id_of(key) -> Column:
    """``TKT-`` and ten upper-case hex characters, derived from the key so that task retries agree."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("TKT-"), F.upper(F.substring(F.sha2(k, 256), 1, 10)))


def flatten_metadata(m) -> Column:
    """Scalar entries of a metadata map, keys prefixed ``meta_``."""
    m = F.col(m) if isinstance(m, str) else m
    scalar = F.map_filter(m, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    return F.transform_keys(scalar, lambda k, v: F.concat(F.lit("meta_"), k))


def restore_metadata(m) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    own = F.map_filter(m, lambda k, v: F.startswith(k, F.lit("meta_")))
    return F.transform_keys(own, lambda k, v: F.substring(k, F.lit(6), F.length(k)))


def audit_rows(responses: DataFrame) -> DataFrame:
    """Responses as audit rows: arrays become JSON text, ``day`` is the partition key."""
    return responses.withColumns({
        "citations": F.to_json("citations"),
        "tool_calls": F.to_json("tool_calls"),
        "day": F.to_date("timestamp"),
    })


def append_audit(responses: DataFrame, path: str) -> None:
    audit_rows(responses).write.mode("append").partitionBy("day").parquet(path)
