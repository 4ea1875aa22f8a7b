"""Multi-part questions: model output parsing, labels, and merging of sub-responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import maths
from askloom.functions import text as tx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_json_pair(raw) -> Column:
    """The first object in a raw model output that parses and has a question: struct(query, answer)."""
    found = F.regexp_extract_all(_c(raw), F.lit(r"\{[\s\S]*?\}"), 0)
    parsed = F.transform(found, lambda m: F.from_json(F.regexp_replace(m, r"\n+", " "), "query string, answer string"))
    trimmed = F.transform(parsed, lambda p: F.struct(
        tx.strip(p["query"]).alias("query"), tx.strip(F.coalesce(p["answer"], F.lit(""))).alias("answer")))
    return F.get(F.filter(trimmed, lambda p: p["query"] != ""), F.lit(0))


def first_json_strings(raw) -> Column:
    """The first array in a raw model output that parses and holds only strings."""
    found = F.regexp_extract_all(_c(raw), F.lit(r"\[[\s\S]*?\]"), 0)
    ok = F.filter(found, lambda m: F.schema_of_variant(F.try_parse_json(m)).isin("ARRAY<STRING>"))
    return F.get(F.transform(ok, lambda m: F.from_json(m, "array<string>")), F.lit(0))


def merge_responses(subs: DataFrame, parent: str, pos: str = "pos", parallel: bool = False) -> DataFrame:
    """One response per parent from its sub-responses, in sub-query order.

    Expects answer, sub_queries, citations (array of structs with chunk_id), tool_calls,
    confidence, iterations, ticket_id, alpha, latency_ms, ttft_ms, verify_verdict, model_tag.
    """
    row = F.struct(F.col(pos).alias("p"), "answer", "sub_queries", "citations", "tool_calls")
    header = lambda s: F.coalesce(F.get(s["sub_queries"], F.lit(0)), F.lit("(sub-query)"))
    v = F.lower("verify_verdict")
    grouped = subs.groupBy(parent).agg(
        F.array_sort(F.collect_list(row)).alias("s"),
        F.min("confidence").alias("confidence"), F.max("iterations").alias("iterations"),
        F.min_by("ticket_id", F.when(F.col("ticket_id").isNotNull() & (F.col("ticket_id") != ""), F.col(pos))).alias("ticket_id"),
        F.avg("alpha").alias("alpha"),
        F.coalesce((F.max if parallel else F.sum)("latency_ms"), F.lit(0.0)).alias("latency_ms"),
        F.min("ttft_ms").alias("ttft_ms"),
        F.coalesce(F.min_by("model_tag", F.when(F.col("model_tag") != "", F.col(pos))), F.lit("")).alias("model_tag"),
        F.max(F.contains(v, F.lit("contradict"))).alias("_c"), F.max(v == "neutral").alias("_n"),
        F.max(F.contains(v, F.lit("entail"))).alias("_e"), F.min(v).alias("_v"),
    )
    cites = F.flatten(F.transform("s", lambda x: x["citations"]))
    ids = F.transform(cites, lambda c: c["chunk_id"])
    return grouped.select(
        parent,
        F.array_join(F.transform("s", lambda x: F.concat(F.lit("For ["), header(x), F.lit("]:\n"), tx.strip(F.coalesce(x["answer"], F.lit(""))))), "\n\n").alias("answer"),
        F.filter(cites, lambda c, i: F.array_position(ids, c["chunk_id"]) == i + 1).alias("citations"),
        F.flatten(F.transform("s", lambda x: x["tool_calls"])).alias("tool_calls"),
        F.flatten(F.transform("s", lambda x: x["sub_queries"])).alias("sub_queries"),
        "confidence", "iterations", "ticket_id", "alpha", "latency_ms", "ttft_ms", "model_tag",
        F.when(F.col("_c"), "contradiction").when(F.col("_n"), "neutral").when(F.col("_e"), "entailment").otherwise(F.col("_v")).alias("verify_verdict"),
    )


def decomposition_labels(questions: DataFrame, key: str, text: str, per_class: int, seed: int = 42) -> DataFrame:
    """``per_class`` multi-part and as many single-part questions in a seeded order; a short class is filled from the rest.

    The limits are the label budget the caller asks for. Each class is one global top-n,
    which Spark takes per task first.
    """
    order = [maths.hash_order(F.col(key), seed), F.col(key)]
    marked = questions.withColumn("_multi", tx.multi_part_by_word(text))
    multi = marked.filter("_multi").orderBy(*order).limit(per_class)
    single = marked.filter("NOT _multi").orderBy(*order).limit(per_class)
    rest = marked.join(multi.unionByName(single).select(key), key, "left_anti")
    n_multi, n_single = multi.count(), single.count()
    if n_multi < per_class:
        multi = multi.unionByName(rest.orderBy(*order).limit(per_class - n_multi))
    if n_single < per_class:
        single = single.unionByName(rest.orderBy(*order).limit(per_class - n_single))
    subs = F.when(F.col("is_multi_part"), tx.split_labelled(text)).otherwise(F.array(text))
    both = multi.withColumn("is_multi_part", F.lit(True)).unionByName(single.withColumn("is_multi_part", F.lit(False)))
    return both.select(key, text, "is_multi_part", subs.alias("sub_queries"))
