"""Evaluation tables: per query, per model, ablations, significance, side-loaded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom import util
from askloom.functions import maths
from askloom.functions import text as tx
from askloom.operators import metrics as m
from askloom.operators.audit import interpolated

METRICS = ("recall_at_20", "grounding", "citation_f1", "rouge1", "rouge2", "rougeL", "ctx_rouge1", "ctx_rouge2", "ctx_rougeL", "completeness", "citation_coverage", "fcrs")


def per_query(responses: DataFrame, gold: DataFrame, query: str = "query_id") -> DataFrame:
    """One metric row per (model_tag, query) in one pass after the join with gold.

    responses: model_tag, query, answer, retrieved (ids), citations (doc_id, span_start,
    span_end, cited_text), tools, ticket_id, confidence, iterations, latency_ms, ttft_ms.
    gold: query, gold_answer, gold_ids, gold_citations, needed_tool, should_escalate.
    Where they are present: ``grounding_citations`` (the wider set that grounding and
    context scores use in place of ``citations``), ``decomposed`` and gold ``is_multi_part``,
    ``tool_args`` (a map of string arguments for each of ``tools``, in their order) and gold
    ``needed_args``: the best argument F1 among the calls of the needed tool. Where either is
    missing, arguments count as right with the tool's name.
    """
    j = responses.join(gold, query)
    wide = "grounding_citations" if "grounding_citations" in j.columns else "citations"
    gold_text = tx.strip_citations(F.coalesce("gold_answer", F.lit("")), "hex8")
    j = j.withColumns({
        "gold_text": gold_text,
        "gold_docs": F.transform("gold_citations", lambda c: c["doc_id"]),
        "context": F.array_join(F.transform(F.filter(wide, lambda c: F.coalesce(c["cited_text"], F.lit("")) != ""), lambda c: c["cited_text"]), " "),
    })
    j = j.withColumns({
        "key_points": tx.sentences("gold_text"), "_at": tx.tokens_alnum("answer"), "_gt": tx.tokens_alnum("gold_text"), "_ct": tx.tokens_alnum("context"),
        "cf": m.citation_scores("citations", "gold_citations"),
    })
    j = j.withColumns({
        "completeness": m.completeness("answer", "key_points"),
        "citation_coverage": m.citation_coverage("answer", "citations", "gold_docs"),
        "tool_appropriateness": m.tool_appropriateness("tools", "needed_tool"),
        "escalation_accuracy": m.escalation_accuracy("ticket_id", "should_escalate"),
    })
    cited = F.transform("citations", lambda c: c["doc_id"])
    flag = lambda c: F.col(c) if c in j.columns else F.lit(None).cast("boolean")
    j = j.withColumns({"decomposed": flag("decomposed"), "is_multi_part": flag("is_multi_part")})
    rouge = lambda p, t, n, f: F.round(m.rouge_n(p, t, n)[f], 4)
    return j.select(
        "model_tag", query, "latency_ms", "ttft_ms", "iterations", "confidence",
        m.recall_with_fallback("retrieved", cited, cited, "gold_ids", "gold_docs").alias("recall_at_20"),
        m.grounding("answer", "context").alias("grounding"),
        F.col("cf.f1").alias("citation_f1"), F.col("cf.precision").alias("citation_precision"), F.col("cf.recall").alias("citation_recall"),
        F.when(F.col("gold_text") != "", rouge("_at", "_gt", 1, "f1")).alias("rouge1"),
        F.when(F.col("gold_text") != "", rouge("_at", "_gt", 2, "f1")).alias("rouge2"),
        F.when(F.col("gold_text") != "", F.round(m.rouge_l("_at", "_gt")["f1"], 4)).alias("rougeL"),
        rouge("_ct", "_at", 1, "recall").alias("ctx_rouge1"), rouge("_ct", "_at", 2, "recall").alias("ctx_rouge2"),
        F.round(m.rouge_l("_ct", "_at")["recall"], 4).alias("ctx_rougeL"),
        F.when(F.col("needed_tool").isNotNull(), m.tool_name_match("tools", "needed_tool")).alias("tool_name_match"),
        F.when(F.col("needed_tool").isNotNull(), _argument_f1(j)).alias("tool_arg_f1"),
        "completeness", "citation_coverage", "tool_appropriateness", "escalation_accuracy",
        m.fcrs("completeness", "citation_coverage", "tool_appropriateness", "escalation_accuracy", "needed_tool", "should_escalate").alias("fcrs"),
        F.col("ticket_id").isNotNull().alias("escalated"), "should_escalate", "decomposed", "is_multi_part",
    )


def _argument_f1(joined: DataFrame) -> Column:
    name = m.tool_name_match("tools", "needed_tool")
    if not {"tool_args", "needed_args"} <= set(joined.columns):
        return name
    calls = F.filter(F.arrays_zip("tools", "tool_args"), lambda c: c["tools"] == F.col("needed_tool"))
    none = F.create_map().cast("map<string,string>")
    best = F.array_max(F.transform(calls, lambda c: m.arg_f1(F.coalesce(c["tool_args"], none), F.col("needed_args"))))
    return F.when(F.col("needed_args").isNull() | F.col("tool_args").isNull(), name).otherwise(F.coalesce(best, F.lit(0.0)))


def binary_prf(predicted, gold) -> dict[str, Column]:
    """Aggregates precision, recall, f1 of two Boolean columns; 0 where undefined."""
    p, g = (F.col(c) if isinstance(c, str) else c for c in (predicted, gold))
    tp, fp, fn = F.count_if(p & g), F.count_if(p & ~g), F.count_if(~p & g)
    return {"precision": m.share(tp, tp + fp), "recall": m.share(tp, tp + fn), "f1": m.share(2 * tp, 2 * tp + fp + fn)}


def loop_efficiency(iterations: str = "iterations") -> Column:
    """Mean iterations; null when no response looped."""
    return F.when(F.max(iterations) > 0, F.avg(iterations))


def aggregate(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """Per-model means (nulls skipped), latency percentiles, loop efficiency, escalation F1 where any is due.

    The rows are written once; percentiles come from ranks over range partitions, so that no
    task holds the latencies of a model.
    """
    rows = util.staged(rows, "evaluated")
    mean = [F.avg(c).alias(c) for c in (*METRICS, "citation_precision", "citation_recall", "tool_name_match", "tool_arg_f1", "tool_appropriateness", "escalation_accuracy")]
    means = rows.groupBy("model_tag").agg(
        F.count("*").alias("n_queries"), *mean, F.avg("latency_ms").alias("latency_mean"),
        loop_efficiency().alias("loop_efficiency"),
        F.when(F.max("should_escalate"), binary_prf("escalated", "should_escalate")["f1"]).alias("escalation_f1"),
        F.when(F.count("is_multi_part") > 0, binary_prf(F.coalesce("decomposed", F.lit(False)) & F.col("is_multi_part").isNotNull(), F.coalesce("is_multi_part", F.lit(False)))["f1"]).alias("decomposition_f1"),
    )
    for name in ("latency", "ttft"):
        percents = interpolated(rows, "model_tag", f"{name}_ms", query, {f"{name}_p50": 50, f"{name}_p95": 95})
        means = means.join(percents.withColumnRenamed("model_tag", "_tag"), F.col("model_tag").eqNullSafe(F.col("_tag")), "left").drop("_tag")
    return means


def long_form(summary: DataFrame, columns: list[str]) -> DataFrame:
    """(model_tag, metric, value) rows."""
    return summary.unpivot(["model_tag"], columns, "metric", "value")


def wide_form(long: DataFrame, tags: list[str]) -> DataFrame:
    """A row per metric with a column per model."""
    return long.groupBy("metric").pivot("model_tag", tags).agg(F.first("value"))


def ablation(summary: DataFrame, full: str, metric: str = "fcrs") -> DataFrame:
    """Each variant's metric and its difference from the full system."""
    base = summary.filter(F.col("model_tag") == full).select(F.col(metric)).scalar()
    return summary.select("model_tag", F.col(metric), (F.col(metric) - base).alias("delta"))


def consistency(answers: DataFrame, query: str, answer: str) -> DataFrame:
    """Share of a query's answers that equal its most common normalised answer."""
    norm = F.array_join(tx.tokens_alnum(answer), " ")
    counts = answers.groupBy(query, F.md5(norm).alias("form")).agg(F.count("*").alias("n"))
    return counts.groupBy(query).agg((F.max("n") / F.sum("n")).alias("consistency"))


BLOCK = 4096  # rows whose differences travel together as one array
_HANDS = 16  # tasks that share the repetitions of a block


def numbered_differences(rows: DataFrame, reference: str, metric: str, query: str) -> tuple[DataFrame, DataFrame]:
    """Differences from ``reference``: (model_tag, pos from 0, n, d) and (model_tag, n, observed mean).

    Positions are ranks over range partitions, so no task numbers a whole model. Pairs with a missing value are left out.
    """
    ref = rows.filter(F.col("model_tag") == reference).select(query, F.col(metric).alias("_b"))
    diff = rows.filter(F.col("model_tag") != reference).join(ref, query).select("model_tag", query, (F.col(metric) - F.col("_b")).alias("d"))
    ranked = util.global_rank(diff.filter("d IS NOT NULL"), [F.col("model_tag"), F.col(query), F.col("d")], "_r")
    models = util.staged(ranked.groupBy("model_tag").agg(F.min("_r").alias("_lo"), F.count("*").alias("n"), F.avg("d").alias("observed")), "models")
    at = ranked.join(models.select("model_tag", "_lo", "n"), "model_tag").select("model_tag", (F.col("_r") - F.col("_lo")).alias("pos"), "n", "d")
    return at, models.drop("_lo")


def block_draws(at: DataFrame, models: DataFrame, reps: int, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(model_tag, n, rep, block, c): how many of a repetition's n draws fall into each block of positions.

    A multinomial split: each row stands for one draw of every repetition and hashes to the
    position it takes. Only the counts per block are shuffled, combined in the task before.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    one = models.filter(F.col("n") <= block).select("model_tag", "n", rep, F.lit(0).cast("bigint").alias("block"), F.col("n").alias("c"))
    drawn = at.filter(F.col("n") > block).select("model_tag", "n", "pos", rep)
    place = maths.hash_below(F.concat_ws(":", F.col("pos").cast("string"), F.col("rep").cast("string")), seed, F.col("n"))
    many = drawn.select("model_tag", "n", "rep", place.alias("place")).groupBy(
        "model_tag", "n", "rep", F.floor(F.col("place") / block).alias("block")).agg(F.count("*").alias("c"))
    return one.unionByName(many)


def bootstrap_p(rows: DataFrame, reference: str, metric: str = "fcrs", reps: int = 1000, seed: int = 42, query: str = "query_id", block: int = BLOCK) -> DataFrame:
    """Two-sided paired-bootstrap p-value of every model against ``reference``.

    Every repetition draws exactly as many pairs as there are, with replacement: first the
    number of draws of each block of positions, then the rows inside the block, both from
    hashes of (position, repetition). A block is one array of at most ``block`` numbers, and
    its repetitions are dealt over several tasks. Pairs with a missing value are left out;
    no pairs gives 1.
    """
    at, models = numbered_differences(rows, reference, metric, query)
    keys = ["model_tag", "block", "hand"]
    counts = block_draws(at, models, reps, seed, block).withColumn("hand", F.col("rep") % _HANDS)
    held = at.groupBy("model_tag", F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("s"))
    held = held.select("model_tag", "block", F.transform("s", lambda x: x["d"]).alias("ds"), F.explode(F.sequence(F.lit(0), F.lit(_HANDS - 1))).alias("hand"))
    drawn = util.spread(counts, *keys).join(util.spread(held, *keys), keys)
    name = lambda t: F.concat_ws(":", F.col("block").cast("string"), t.cast("string"), F.col("rep").cast("string"))
    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("c")), F.lit(0.0), lambda acc, t: acc + F.get("ds", maths.hash_below(name(t), seed, F.size("ds")).cast("int")))
    means = drawn.select("model_tag", "n", "rep", total.alias("total")).groupBy("model_tag", "rep").agg((F.sum("total") / F.max("n")).alias("mean"))
    p = means.join(models, "model_tag").groupBy("model_tag").agg(
        F.avg(F.when(F.abs(F.col("mean") - F.col("observed")) >= F.abs("observed"), 1.0).otherwise(0.0)).alias("p_value"))
    tags = rows.filter(F.col("model_tag") != reference).select("model_tag").distinct()
    return tags.join(p, "model_tag", "left").select("model_tag", F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def significance(p_values: DataFrame, level: float = 0.05) -> DataFrame:
    return p_values.withColumn("significant", F.col("p_value") < level)


def sideload(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """Per-model results from the detail table where there is one, else from the summary."""
    dt = detail.select("model_tag", F.col("latency").alias("_d"), "n_rows")
    return summary.join(dt, "model_tag", "left").select(
        "model_tag", F.coalesce("_d", "latency").alias("latency"), F.col("_d").isNotNull().alias("has_detail"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
