"""Answering variants as feature switches over shared candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions import text as tx
from askloom.operators import decompose, responses, routing
from askloom.operators.retrieve import fused
from askloom.util import broadcast_if, staged


def run_variants(cand: DataFrame, alphas: DataFrame, queries: DataFrame, k: int, tags: dict[str, dict] = fixed.VARIANTS) -> DataFrame:
    """Rankings of every variant with its switches.

    Variants that rank alike (all with the default fusion weight) share one ranking and are
    told apart by an added column; only adaptive ones are fused again.
    """
    parts = []
    for adaptive in (False, True):
        flags = {t: f for t, f in tags.items() if f["adaptive_alpha"] is adaptive}
        if not flags:
            continue
        if adaptive:
            ranked = fused(cand.join(broadcast_if(alphas, queries), "query_id"), F.col("alpha"), k)
        else:
            ranked = fused(cand, fixed.ALPHA_DEFAULT, k)
        rows = F.array(*[F.struct(F.lit(t).alias("tag"), *[F.lit(v).alias(n) for n, v in f.items()]) for t, f in flags.items()])
        parts.append(ranked.select("query_id", "doc_id", "score", "rank", F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parts_of(queries: DataFrame, split: bool) -> DataFrame:
    """(query_id, text, parent, pos): each query as ``id/0``, or, where it has several parts and ``split`` is set, one row per part."""
    several = tx.multi_part_by_split("text") if split else F.lit(False)
    pieces = F.when(several, tx.split_sub_queries("text")).otherwise(F.array("text"))
    rows = queries.select(F.col("query_id").alias("parent"), F.posexplode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array("text"))).alias("pos", "text"))
    return rows.select(F.concat_ws("/", F.col("parent").cast("string"), F.col("pos").cast("string")).alias("query_id"), "text", "parent", "pos")


def merged(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """One response per parent: parts are merged in their order, a query of one part stays as it is."""
    shape = ["parent", "n_parts", "answer", "confidence", "iterations", "ticket_id", "verify_verdict", "citations", "tools"]
    counts = parts.groupBy("parent").agg(F.count("*").alias("n_parts"))
    told = rows.join(parts.select("query_id", "parent", "pos"), "query_id").join(counts, "parent").withColumns({
        "tools": F.transform("tool_calls", lambda c: c["tool"]),
        "citations": F.coalesce("citations", F.array().cast(rows.schema["citations"].dataType))})
    one = told.filter("n_parts = 1").select(*shape)
    none = F.lit(None).cast("double")
    subs = told.filter("n_parts > 1").drop("tool_calls").withColumns({
        "sub_queries": F.array("text"), "tool_calls": F.col("tools"), "alpha": none, "latency_ms": none, "ttft_ms": none, "model_tag": F.lit("")})
    joined = decompose.merge_responses(subs, "parent").withColumnRenamed("tool_calls", "tools").withColumn("n_parts", F.size("sub_queries").cast("bigint"))
    return one.unionByName(joined.select(*shape))


def run_stages(queries: DataFrame, stages: Callable[[bool], tuple], finish: Callable[[tuple, DataFrame], DataFrame], tags: dict[str, dict] = fixed.VARIANTS) -> DataFrame:
    """Responses of every variant; its switches decide which stages run.

    ``stages(adaptive)`` gives the callables of ``routing.action_loop``; ``finish`` makes
    full responses of an outcome. Without ``action_loop`` the first ranking is answered once;
    without ``verify`` no answer is judged; with ``decomposition`` questions of several parts
    are asked part by part and merged. Variants with equal switches share one run, and equal
    first rankings are made once.
    """
    runs: dict[tuple, list[str]] = {}
    for tag, f in tags.items():
        runs.setdefault((f["action_loop"], f["verify"], f["adaptive_alpha"], f["decomposition"]), []).append(tag)
    firsts: dict[tuple, tuple] = {}
    out = None
    for (loop, verified, adaptive, split), names in runs.items():
        if (adaptive, split) not in firsts:
            parts = staged(parts_of(queries, split), "parts")
            asked, how = parts.select("query_id", "text"), stages(adaptive)
            firsts[adaptive, split] = parts, how, staged(how[1](how[0](asked), asked), "first")
        parts, (find, rerank, score, verify, topics), first = firsts[adaptive, split]
        asked = parts.select("query_id", "text")
        if loop:
            outcome = routing.action_loop(asked, find, rerank, score, verify if verified else None, topics, first=first)
        else:
            outcome = responses.single_pass(asked, first)
        rows = merged(finish(outcome, asked), parts).withColumn("tag", F.explode(F.array(*[F.lit(t) for t in names])))
        out = rows if out is None else out.unionByName(rows)
    return out
