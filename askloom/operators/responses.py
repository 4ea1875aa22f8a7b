"""Full response rows: answer, citations in two widths, tool calls, verdict, ticket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.operators.citations import citation_struct
from askloom.operators.retrieve import build_citations
from askloom.operators.tools import policy_lookup
from askloom.sources.records import ticket_id_of
from askloom.util import broadcast_if, staged


def single_pass(queries: DataFrame, ranked: DataFrame, query: str = "query_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``routing.action_loop`` returns, for variants without it: every query with candidates is answered once, unrouted."""
    found = queries.join(ranked.select(query).distinct().withColumn("_f", F.lit(True)), query, "left")
    action = F.when(F.col("_f"), "answer").otherwise("ticket")
    none = F.lit(None)
    done = found.select(query, action.alias("action"), none.cast("double").alias("confidence"), F.lit(0).alias("iterations"), F.when(F.col("_f").isNull(), "no_candidates").alias("reason"))
    steps = found.select(query, F.lit(0).alias("iteration"), "text", action.alias("tier"), none.cast("string").alias("tool"), none.cast("double").alias("confidence"),
                         none.cast("string").alias("verdict"), F.lit(True).alias("final"))
    return done, ranked.withColumn("iteration", F.lit(0)), steps


def call_tools(steps: DataFrame, ranked: DataFrame, topics: DataFrame, policies: DataFrame, query: str = "query_id", k: int = 5) -> DataFrame:
    """(query, iteration, result) of the tools that the middle tier chose.

    SearchKB gives the ``k`` best documents of the round's search; GetPolicy looks up the
    section (``policies``: section_id, pos) that most documents of the round belong to.
    """
    step = [query, "iteration"]
    asked = steps.filter("tool IS NOT NULL").select(*step, "tool")
    rows = ranked.select(*step, "doc_id", "rank").join(broadcast_if(asked, steps), step)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]), ",")
    searched = rows.filter((F.col("tool") == "SearchKB") & (F.col("rank") <= k)).groupBy(*step).agg(ids.alias("result"))
    named = rows.filter("tool = 'GetPolicy'").join(topics, "doc_id").groupBy(*step, "topic").agg(F.count("*").alias("n"))
    request = named.groupBy(*step).agg(F.min_by("topic", F.struct((-F.col("n")).alias("n"), "topic")).alias("section_id"))
    return searched.unionByName(policy_lookup(request, policies).select(*step, F.col("found_id").alias("result")))


def tool_calls(steps: DataFrame, results: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, tool_calls): what each round called, in order, with the confidence before and after."""
    before = steps.select(query, (F.col("iteration") + 1).alias("iteration"), F.col("confidence").alias("confidence_before"))
    s = steps.join(before, [query, "iteration"], "left").join(results, [query, "iteration"], "left")
    tier, final = F.col("tier"), F.col("final")
    call = lambda on, n, tool, result: F.when(on, F.struct(
        F.col("iteration").alias("iteration"), F.lit(n).alias("step"), tool.alias("tool"), F.col("text").alias("query"), result.cast("string").alias("result"),
        F.col("confidence_before").alias("confidence_before"), F.col("confidence").alias("confidence_after")))
    calls = F.array(
        call(tier == "tool_retry", 0, F.coalesce("tool", F.lit("SearchKB")), F.col("result")),
        call((tier == "tool_retry") & final, 1, F.lit("AnswerDirect"), F.lit(None)),
        call(tier.isin("answer", "answer_verify"), 1, F.lit("AnswerDirect"), F.lit(None)),
        call(F.col("verdict").isNotNull(), 2, F.lit("AnswerVerify"), F.col("verdict")),
        call(tier == "ticket", 3, F.lit("CreateTicket"), ticket_id_of(F.col(query).cast("string"))))
    listed = s.select(query, F.filter(calls, lambda c: c.isNotNull()).alias("c"))
    return listed.groupBy(query).agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("tool_calls"))  # a few per round


def cited(ranked: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = fixed.MAX_CITATIONS, chars: int = 2000, query: str = "query_id") -> DataFrame:
    """(query, citations, grounding_citations): those near the best score, and the wider set of the first ``limit``; texts of ``chars`` characters."""
    wide = build_citations(ranked, limit, filtered=False, query=query).select(query, "doc_id", "rank")
    near = build_citations(ranked, limit, query=query).select(query, "doc_id", F.lit(True).alias("near"))
    marked = staged(wide.join(near, [query, "doc_id"], "left"), "marked")
    text = docs.select("doc_id", F.left("text", F.lit(chars)).alias("t")).join(broadcast_if(marked), "doc_id")
    c = citation_struct(F.col("doc_id"), F.col("doc_id").cast("string"), F.lit(0), F.length("t"), F.col("t"))
    ordered = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("rank", c.alias("c"))))), lambda x: x["c"])
    return text.groupBy(query).agg(ordered(F.col("near")).alias("citations"), ordered(F.lit(True)).alias("grounding_citations"))


def full(outcome: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, docs: DataFrame, topics: DataFrame, policies: DataFrame,
         answer: Callable[[Column], Column], query: str = "query_id") -> DataFrame:
    """One complete row per query from the outcome of the loop (or of one pass).

    Citations and retrieved ids are those of the query's last round. ``answer`` makes the
    answer from the wider citations; a ticket has none, but keeps what was found.
    """
    done, seen, steps = (staged(x, "outcome") for x in outcome)
    last = steps.filter("final").select(query, "iteration", "verdict")
    ranked = seen.join(last.select(query, "iteration"), [query, "iteration"]).select(query, "doc_id", "score", "rank")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    retrieved = ranked.groupBy(query).agg(ids.alias("retrieved"))
    calls = tool_calls(steps, call_tools(steps, seen, topics, policies, query), query)
    out = queries.select(query, "text").join(done, query).join(last.drop("iteration"), query, "left").join(retrieved, query, "left").join(
        cited(ranked, docs, queries, query=query), query, "left").join(calls, query, "left")
    ticket = F.col("action") == "ticket"
    return out.select(
        query, "text", "action", F.when(~ticket, answer(F.col("grounding_citations"))).alias("answer"), "confidence", "iterations", "reason", F.col("verdict").alias("verify_verdict"),
        F.when(ticket, ticket_id_of(F.col(query).cast("string"))).alias("ticket_id"), "retrieved", "citations", "grounding_citations", "tool_calls")
