"""Routing by confidence, answer verification and the retry loop, for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.operators.retrieve import drop_seen
from askloom.util import cut_lineage, settle


def route_tier(confidence, has_candidates=None, high: float = fixed.CONF_HIGH, medium: float = fixed.CONF_MEDIUM, low: float = fixed.CONF_LOW) -> Column:
    """answer, answer_verify, tool_retry or ticket."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    found = F.lit(True) if has_candidates is None else has_candidates
    return (
        F.when(~found | c.isNull(), "ticket").when(c >= high, "answer").when(c >= medium, "answer_verify")
        .when(c >= low, "tool_retry").otherwise("ticket"))


def mid_tier_tool(probs) -> Column:
    p = F.col(probs) if isinstance(probs, str) else probs
    return F.when((F.size(p) >= 4) & (F.get(p, F.lit(2)) > F.get(p, F.lit(1))), "GetPolicy").otherwise("SearchKB")


def verify_thresholds(iteration) -> dict[str, Column]:
    """Thresholds after ``iteration`` retries: 0.15 lower each time, down to their floors."""
    it = F.col(iteration) if isinstance(iteration, str) else iteration
    lowered = lambda base, floor: F.greatest(F.lit(floor), F.lit(base) - 0.15 * it)
    return {"pass": lowered(fixed.VERIFY_PASS, 0.10), "partial": lowered(fixed.VERIFY_PARTIAL, 0.05), "entail": lowered(fixed.VERIFY_ENTAIL, 0.10)}


def lexical_entailment(premise: Column, sentence: Column) -> Column:
    """Default scorer: share of the sentence's distinct tokens found in the premise."""
    return maths.overlap(tx.tokens_alnum(sentence), tx.tokens_alnum(premise))


def verify_answers(answers: DataFrame, citations: DataFrame, key: str, answer: str = "answer", scorer=lexical_entailment, n_premise: int = 3,
                   confidence: str | None = None, iteration=F.lit, thresholds: dict[str, Column] | None = None) -> DataFrame:
    """(key, verdict, grounding_score, n_sentences): share of sentences entailed by the cited text.

    A sentence's premise is the text of the document its own marker names, else the first
    ``n_premise`` cited texts. Answers at or above the skip confidence are set aside before
    the scorer runs, because Spark does not push filters through a Python scorer.
    """
    th = thresholds or verify_thresholds(F.lit(0))
    skip = F.lit(False) if confidence is None else F.coalesce(F.col(confidence) >= fixed.VERIFY_SKIP, F.lit(False))
    skipped = answers.filter(skip).select(key, F.lit("skipped").alias("verdict"), F.lit(None).cast("double").alias("grounding_score"), F.lit(0).cast("bigint").alias("n_sentences"))
    judged = answers.filter(~skip)
    by_doc = citations.groupBy(key, F.col("doc_id").cast("string").alias("doc_id")).agg(F.max_by("cited_text", "rank").alias("own"))
    joined = citations.filter(F.col("rank") <= n_premise).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cited_text"))), lambda x: x["cited_text"]), " ").alias("premise"))
    sents = judged.select(key, F.posexplode_outer(tx.sentences(answer)).alias("pos", "raw")).filter("raw IS NOT NULL")
    sents = sents.select(key, "pos", F.get(tx.citation_markers("raw"), F.lit(0))["doc_id"].alias("doc_id"), tx.strip_citations("raw").alias("sentence")).filter("sentence <> ''")
    scored = sents.join(by_doc, [key, "doc_id"], "left").join(joined, key, "left").select(key, "sentence", F.coalesce("own", "premise").alias("premise"))
    p = F.coalesce(scorer(F.col("premise"), F.col("sentence")), F.lit(0.0))
    share = scored.select(key, (p >= th["entail"]).cast("int").alias("ok")).groupBy(key).agg(F.avg("ok").alias("g"), F.count("*").alias("n"))
    out = judged.join(share, key, "left").join(citations.select(key).distinct().withColumn("_c", F.lit(True)), key, "left")
    g = F.when(F.col("_c").isNull(), 0.0).otherwise(F.coalesce("g", F.lit(0.0)))
    verdict = F.when(g >= th["pass"], "pass").when(g >= th["partial"], "partial").otherwise("fail")
    verdict = F.when(F.col("_c").isNull() | F.col("g").isNull(), "fail").otherwise(verdict)
    return out.select(key, verdict.alias("verdict"), g.alias("grounding_score"), F.coalesce("n", F.lit(0)).alias("n_sentences")).unionByName(skipped)


def action_loop(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rerank: Callable[[DataFrame, DataFrame], DataFrame],
                score: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame, int], DataFrame] | None, topics: DataFrame,
                rounds: int = fixed.MAX_ITERATIONS, query: str = "query_id", first: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Up to ``rounds`` rounds of retrieve, drop seen, rerank, score, route; the rest is answered as well as it can be.

    ``queries`` has (query, text). The callables take and give DataFrames: ranked
    (query, doc_id, score, rank), confidences (query, confidence and, where a tool model gives
    them, tool_probs), verdicts (query, verdict). Without ``verify`` no answer is verified.
    ``first`` holds reranked rows of the first round, where a caller has them already.
    The plan is unrolled per round and cut by a reliable checkpoint; no rows pass through
    the driver. Returns (responses, reranked rows of every round, steps of every round:
    query, iteration, text, tier, tool, confidence, verdict, final).
    """
    active, seen, done, steps = queries.withColumn("original", F.col("text")), None, None, None
    shape = [query, "action", "confidence", "iterations", "reason"]
    for it in range(rounds):
        last = it == rounds - 1
        if it == 0 and first is not None:
            ranked = first.withColumn("iteration", F.lit(it))
        else:
            found = retrieve(active.select(query, "text"))
            if seen is not None:
                found = drop_seen(found, seen, query)
            ranked = cut_lineage(rerank(found, active.select(query, "text")).withColumn("iteration", F.lit(it)))
        seen = ranked if seen is None else seen.unionByName(ranked)
        conf = active.join(score(ranked), query, "left")
        tier = conf.withColumn("tier", route_tier("confidence"))
        if verify is None:
            tier = tier.withColumn("verdict", F.lit(None).cast("string"))
        else:
            tier = tier.join(verify(tier.filter("tier = 'answer_verify'"), ranked, it).select(query, "verdict"), query, "left")
        retry_verdict = F.lit(False) if last else F.coalesce(F.col("verdict").isin("fail", "partial"), F.lit(False))
        retry = (F.col("tier") == "tool_retry") | ((F.col("tier") == "answer_verify") & retry_verdict)
        state = cut_lineage(tier.withColumn("retry", retry).withColumn("iterations", F.lit(it + 1)))
        tool = mid_tier_tool("tool_probs") if "tool_probs" in state.columns else F.lit("SearchKB")
        step = state.select(query, F.lit(it).alias("iteration"), "text", "tier", F.when(F.col("tier") == "tool_retry", tool).alias("tool"), "confidence", "verdict",
                            (F.lit(last) | ~F.col("retry")).alias("final"))
        steps = step if steps is None else steps.unionByName(step)
        reason = F.when(F.col("confidence").isNull(), "no_candidates").otherwise("low_confidence")
        ended = state.filter(F.lit(last) | ~F.col("retry")).select(
            query, F.when(F.col("retry") & F.lit(last), "best_effort").otherwise(F.col("tier")).alias("action"), "confidence", "iterations",
            F.when(F.col("tier") == "ticket", reason).alias("reason"))
        done = ended if done is None else done.unionByName(ended)
        if not last:
            named = ranked.join(topics, "doc_id", "left").groupBy(query).agg(F.collect_set("topic").alias("topics"))
            hint = F.when(F.col("tier") == "tool_retry", 0).otherwise(it + 1)
            again = state.filter("retry").join(named, query, "left")
            active = cut_lineage(again.select(query, tx.refine_query("original", F.coalesce("topics", F.array().cast("array<string>")), hint).alias("text"), "original"))
    return done.select(*shape), seen, steps


def previous_confidence(steps: DataFrame, session: str, order: str, confidence: str) -> DataFrame:
    """Confidence before and after each step.

    Rows are placed by ranges of (session, order), so a session of any length is spread; the
    last step of each range is carried over to the session's next one.
    """
    spark = settle(steps.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(steps.repartitionByRange(n, session, order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", session).orderBy(order)
    inner = placed.withColumns({"_before": F.lag(confidence).over(w), "_first": F.row_number().over(w) == 1})
    ends = placed.groupBy(F.col(session).alias("_s"), F.col("_pid").alias("_p")).agg(F.max_by(confidence, order).alias("_last"))
    carried = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy("_s").orderBy("_p"))).drop("_last")
    joined = inner.join(carried, inner[session].eqNullSafe(F.col("_s")) & (F.col("_pid") == F.col("_p")))
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    return joined.withColumn("confidence_before", before).withColumnRenamed(confidence, "confidence_after").drop("_pid", "_before", "_first", "_s", "_p", "_carry")
