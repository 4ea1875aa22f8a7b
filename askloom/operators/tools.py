"""Tool calls as data: argument validation, knowledge search, policy lookup, tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.operators import retrieve
from askloom.operators.index import LexicalIndex
from askloom.sources.records import ticket_id_of
from askloom.sources.stores import severity_sla, valid_category, valid_severity
from askloom.util import broadcast_if

# The argument schema of each tool as (field, type, required, enum, minimum, maximum).
TOOL_FIELDS = {
    "SearchKB": (("query", "string", True, None, None, None), ("top_k", "integer", False, None, 1, 50),
                 ("filters", "object", False, None, None, None)),
    "GetPolicy": (("section_id", "string", True, None, None, None), ("fuzzy", "boolean", False, None, None, None)),
    "CreateTicket": (("query", "string", False, None, None, None), ("summary", "string", False, None, None, None),
                     ("category", "string", True, fixed.TICKET_CATEGORIES, None, None),
                     ("severity", "string", True, ("low", "medium", "high", "critical"), None, None),
                     ("user_context", "string", False, None, None, None), ("evidence_gap", "string", False, None, None, None)),
    "AnswerVerify": (("answer", "string", True, None, None, None), ("cited_spans", "array", True, None, None, None),
                     ("confidence", "number", False, None, None, None)),
}


def _kind(args: Column, field: str) -> Column:
    """JSON type of a field: string, integer, number, boolean, object, array or null; SQL null when absent."""
    v = F.try_variant_get(F.try_parse_json(args), f"$.{field}", "variant")
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(s == "STRING", "string").when(s == "BIGINT", "integer")
        .when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(s == "BOOLEAN", "boolean")
        .when(s.rlike("^OBJECT"), "object").when(s.rlike("^ARRAY"), "array").otherwise("null")
    )


def tool_arg_errors(tool, args) -> Column:
    """Error codes of a call: unknown_tool, not_an_object, missing:f, unknown:f, type:f, enum:f, minimum:f, maximum:f."""
    tool, args = (F.col(c) if isinstance(c, str) else c for c in (tool, args))
    keys = F.json_object_keys(args)
    out = F.when(~tool.isin(*TOOL_FIELDS), F.array(F.lit("unknown_tool"))).when(
        keys.isNull(), F.array(F.lit("not_an_object")))
    for name, fields in TOOL_FIELDS.items():
        known = F.array(*[F.lit(f[0]) for f in fields])
        unknown = F.transform(F.filter(keys, lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown:"), k))
        checks = []
        for field, kind, required, enum, low, high in fields:
            present, found = F.array_contains(keys, field), _kind(args, field)
            value = F.get_json_object(args, f"$.{field}")
            fits = found.isin("integer", "number") if kind == "number" else found == kind
            if required:
                checks.append(F.when(~present, f"missing:{field}"))
            checks.append(F.when(present & ~fits, f"type:{field}"))
            if enum:
                checks.append(F.when(present & fits & ~value.isin(*enum), f"enum:{field}"))
            if low is not None:
                checks.append(F.when(present & fits & (value.try_cast("bigint") < low), f"minimum:{field}"))
            if high is not None:
                checks.append(F.when(present & fits & (value.try_cast("bigint") > high), f"maximum:{field}"))
        errors = F.concat(unknown, F.filter(F.array(*checks), lambda e: e.isNotNull()))
        out = out.when(tool == name, F.array_sort(errors))
    return out


GRAM = 8


def _grams(text: Column) -> Column:
    """Distinct substrings of one to eight characters."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.greatest(F.length(text) - i + 1, F.lit(1)))), lambda q: F.substring(text, i, q)))))


def policy_lookup(requests: DataFrame, policies: DataFrame, key: str = "section_id", pos: str = "pos") -> DataFrame:
    """Exact key, else the first key (by position) that contains the requested text, else not found.

    Requests that match exactly leave first. For the rest, a key containing the needle also
    contains the needle's first eight characters (or all of a shorter one), so the substring
    match is an equi-join on short pieces of the keys, checked afterwards; keys are names,
    so their pieces are few. No request is compared with all keys.
    """
    keyed = policies.select(F.col(key).alias("found_id"), F.col(pos).alias("_pos"))
    exact = requests.join(keyed.withColumnRenamed("found_id", key), key, "left")
    hit = exact.filter("_pos IS NOT NULL").select(*requests.columns, F.col(key).alias("found_id"), F.lit(False).alias("fuzzy"))
    missed = exact.filter("_pos IS NULL").select(*requests.columns)
    needles = missed.select(F.lower(key).alias("needle")).filter("needle <> ''").distinct().withColumn("gram", F.left("needle", F.lit(GRAM)))
    pieces = keyed.select("found_id", "_pos", F.lower("found_id").alias("low")).select("*", F.explode_outer(_grams(F.col("low"))).alias("gram"))
    near = pieces.join(needles, "gram").filter(F.contains("low", "needle"))
    best = near.groupBy("needle").agg(F.min_by("found_id", "_pos").alias("found_id"))
    rest = missed.withColumn("needle", F.lower(key)).join(best, "needle", "left").select(
        *requests.columns, "found_id", F.col("found_id").isNotNull().alias("fuzzy"))
    return hit.unionByName(rest)


def escalate(routed: DataFrame, now: Column, reason: str | Column = "low_confidence", key: str = "query_id", text: str = "text") -> DataFrame:
    """Ticket rows with the customer message for routed queries; ids derive from the key, so reruns agree."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    tid = ticket_id_of(F.col(key).cast("string"))
    severity = valid_severity(F.col("severity") if "severity" in routed.columns else F.lit("medium"))
    category = valid_category(F.col("category") if "category" in routed.columns else F.lit("other"))
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.substring(text, 1, 200)) if "summary" in routed.columns else reason
    sla = severity_sla(severity)
    return routed.select(
        key, tid.alias("ticket_id"), F.col(text).alias("query"), summary.alias("summary"), category.alias("category"),
        severity.alias("severity"), reason.alias("evidence_gap"), sla.alias("estimated_response_time"), now.alias("created_at"),
        F.concat(F.lit("No confident answer was found. A specialist will follow up (ticket "), tid, F.lit(", within "), sla,
                 F.lit(").")).alias("message"),
    )


def search_kb(queries: DataFrame, index: LexicalIndex, query_vectors: DataFrame, vectors: DataFrame, docs: DataFrame, k: int = 5,
              scorer=retrieve.lexical_scorer, allowed: DataFrame | None = None, scope: str = "both", query: str = "query_id", text: str = "text") -> DataFrame:
    """Knowledge-base search for all queries: max(4k, 20) fused candidates under a filter, reranked, the best ``k`` with span, text and source."""
    n = max(4 * k, 20)
    found = retrieve.hybrid_fuse(queries, index, query_vectors, vectors, n, query=query, allowed=allowed, scope=scope).select(query, index.doc)
    best = retrieve.rerank_topk(retrieve.with_texts(found, docs, queries, n, index.doc, query, text), k, scorer, query, index.doc)
    at = docs.select(index.doc, F.lit(0).alias("span_start"), F.length(text).alias("span_end"), F.col(text).alias("text"), "source")
    return at.join(broadcast_if(best.select(query, index.doc, "score", "rank"), queries, k), index.doc)
