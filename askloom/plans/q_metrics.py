"""Metrics, evaluation, significance, calibration, latency and audit reports, model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.operators import audit, calibrate, decompose, evaluate, features, intervals, labels, metrics, models, retrieve
from askloom.plans import domain as d
from askloom.plans.domain import sql_alnum, sql_list, sql_sentences
from askloom.plans.registry import query, relation
from askloom.sources.tables import table
from askloom.util import broadcast_if, staged

KEYS = "model_tag", "query_id"


def joined(spark, sf):
    return d.responses(spark, sf).join(d.gold_rows(spark, sf), "query_id")


def sql_rouge(p: str, t: str, n: int) -> str:
    """Clipped matches of the n-grams of two token lists."""
    return f"coalesce(list_sum(list_transform(list_distinct({t}), lambda g: least(len(list_filter({t}, lambda x: x = g)), len(list_filter({p}, lambda x: x = g))))), 0)"


def sql_ngrams(t: str, n: int) -> str:
    return t if n == 1 else f"list_transform(range(1, greatest(len({t}), 1)), lambda i: {t}[i] || ' ' || {t}[i + 1])"


relation("toks", f"""
    SELECT r.*, g.* EXCLUDE (query_id), a1, g1, c1, {sql_ngrams('a1', 2)} AS a2, {sql_ngrams('g1', 2)} AS g2
    FROM (SELECT model_tag, query_id, {sql_alnum('answer')} AS a1, {sql_alnum('gold_answer')} AS g1, {sql_alnum('context')} AS c1 FROM resp JOIN gold_rows USING (query_id)) k
    JOIN resp r USING (model_tag, query_id) JOIN gold_rows g USING (query_id)""", ("resp", "gold_rows"))
relation("m_recall", "SELECT model_tag, query_id, CASE WHEN len(gold_ids) > 0 THEN len(list_intersect(ids[1:20], gold_ids)) / len(gold_ids) END AS recall_at_20 FROM toks", ("toks",))
relation("m_ground", f"""
    SELECT model_tag, query_id, CASE WHEN len(w) = 0 OR len(s) = 0 THEN 0.0 ELSE list_sum(list_transform(w, lambda t: CASE WHEN list_contains(s, t) THEN 1.0 WHEN length(t) >= 5 AND list_contains(p, left(t, 5)) THEN 0.6 ELSE 0.0 END)) / len(w) END AS grounding
    FROM (SELECT *, list_distinct(list_transform(list_filter(s, lambda t: length(t) >= 5), lambda t: left(t, 5))) AS p FROM (
      SELECT model_tag, query_id, list_filter(a1, lambda t: NOT list_contains({sql_list(fixed.GROUNDING_STOPWORDS)}, t)) AS w, list_distinct(c1) AS s FROM toks))""", ("toks",))
relation("m_rouge", f"""
    SELECT model_tag, query_id, m1 / greatest(len(a1), 1) AS p1, m1 / greatest(len(g1), 1) AS r1, round(CASE WHEN len(a1) + len(g1) > 0 THEN 2 * m1 / (len(a1) + len(g1)) ELSE 0 END, 4) AS rouge1,
           round(CASE WHEN len(a2) + len(g2) > 0 THEN 2 * m2 / (len(a2) + len(g2)) ELSE 0 END, 4) AS rouge2, round(CASE WHEN len(a1) > 0 THEN mc / len(a1) ELSE 0 END, 4) AS ctx_rouge1
    FROM (SELECT model_tag, query_id, a1, g1, a2, g2, {sql_rouge('a1', 'g1', 1)} AS m1, {sql_rouge('a2', 'g2', 2)} AS m2, {sql_rouge('cf', 'a1', 1)} AS mc
          FROM (SELECT *, list_filter(c1, lambda x: list_contains(a1, x)) AS cf FROM toks))""", ("toks",))
relation("m_ctx2", f"""
    SELECT model_tag, query_id, round(CASE WHEN len(a2) > 0 THEN {sql_rouge('cf', 'a2', 2)} / len(a2) ELSE 0 END, 4) AS ctx_rouge2
    FROM (SELECT model_tag, query_id, a2, list_filter({sql_ngrams('c1', 2)}, lambda x: list_contains(a2, x)) AS cf FROM toks)""", ("toks",))
# Greedy matching, one prediction after the other, with the used gold positions as state.
relation("m_walk", """
    SELECT model_tag, query_id, 0::BIGINT AS pos, []::BIGINT[] AS used, 0.0::DOUBLE AS tp FROM resp
    UNION ALL
    SELECT model_tag, query_id, pos + 1, CASE WHEN gi IS NULL THEN used ELSE list_append(used, gi) END, tp + CASE WHEN gi IS NULL THEN 0 WHEN ov >= 0.5 THEN 1.0 WHEN ov > 0 THEN 0.5 ELSE 0.25 END
    FROM (SELECT w.model_tag, w.query_id, w.pos, any_value(w.used) AS used, any_value(w.tp) AS tp, arg_max(g.gi, (g.ov, -g.gi)) AS gi, max(g.ov) AS ov
          FROM m_walk w JOIN cites c ON c.model_tag = w.model_tag AND c.query_id = w.query_id AND c.pos = w.pos + 1
          LEFT JOIN m_pairs g ON g.model_tag = w.model_tag AND g.query_id = w.query_id AND g.pos = c.pos AND NOT list_contains(w.used, g.gi)
          GROUP BY w.model_tag, w.query_id, w.pos)""", ("resp", "cites", "m_pairs"))
relation("m_pairs", """
    SELECT c.model_tag, c.query_id, c.pos, g.gi, CASE WHEN c.span_start >= c.span_end THEN 1.0 WHEN g.span_end <= g.span_start THEN 0.0
           ELSE greatest(0, least(c.span_end, g.span_end) - greatest(c.span_start, g.span_start)) / (greatest(c.span_end, g.span_end) - least(c.span_start, g.span_start)) END AS ov
    FROM cites c JOIN gold_cites g ON c.query_id = g.query_id AND c.doc_id = g.doc_id""", ("cites", "gold_cites"))
relation("m_cf", """
    SELECT model_tag, query_id, p AS citation_precision, r AS citation_recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS citation_f1
    FROM (SELECT model_tag, query_id, CASE WHEN len(ids) > 0 THEN tp / len(ids) ELSE 0 END AS p, CASE WHEN len(gold_ids) > 0 THEN tp / len(gold_ids) ELSE 0 END AS r
          FROM toks JOIN (SELECT model_tag, query_id, max(tp) AS tp FROM m_walk GROUP BY ALL) USING (model_tag, query_id))""", ("toks", "m_walk"))
_FACT = rf"(regexp_matches(s, '\d') OR regexp_matches(regexp_extract(s, '(?s)^\S+\s+(.*)$', 1), '{metrics.PROPER}'))"
relation("m_cov", f"""
    SELECT model_tag, query_id, CASE WHEN answer = '' THEN 0.0 WHEN nf IS NULL THEN 1.0 WHEN nv IS NULL THEN 0.0 ELSE nc / nf END AS citation_coverage
    FROM resp LEFT JOIN (
      SELECT model_tag, query_id, count(*) AS nf, count_if(len(t) = 0 OR hit) AS nc FROM (
        SELECT f.model_tag, f.query_id, f.i, any_value(t) AS t, coalesce(bool_or(len(v.w) = 0 OR list_has_any(t, v.w)), false) AS hit
        FROM (SELECT model_tag, query_id, i, {sql_alnum('s')} AS t FROM (SELECT model_tag, query_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT model_tag, query_id, {sql_sentences('answer')} AS ss FROM resp)) WHERE {_FACT}) f
        LEFT JOIN m_valid v USING (model_tag, query_id) GROUP BY ALL) GROUP BY ALL) USING (model_tag, query_id)
    LEFT JOIN (SELECT model_tag, query_id, count(*) AS nv FROM m_valid GROUP BY ALL) USING (model_tag, query_id)""".replace("GROUP BY ALL) GROUP BY ALL)", "GROUP BY f.model_tag, f.query_id, f.i) GROUP BY model_tag, query_id)"), ("resp", "m_valid"))
relation("m_valid", f"SELECT model_tag, query_id, {sql_alnum('cited_text')} AS w FROM cites JOIN gold USING (query_id, doc_id)", ("cites", "gold"))
relation("m_comp", f"""
    SELECT model_tag, query_id, CASE WHEN len(any_value(key_points)) = 0 THEN 1.0 WHEN len(any_value(a1)) = 0 THEN 0.0 ELSE avg(f) END AS completeness FROM (
      SELECT model_tag, query_id, key_points, a1, CASE WHEN len(a1) + len(k) > 0 THEN 2 * {sql_rouge('a1', 'k', 1)} / (len(a1) + len(k)) ELSE 0 END AS f
      FROM (SELECT model_tag, query_id, key_points, a1, {sql_alnum('kp')} AS k FROM (SELECT model_tag, query_id, key_points, a1, unnest(key_points) AS kp FROM toks)))
    GROUP BY model_tag, query_id""", ("toks",))
relation("m_tool", """
    SELECT model_tag, query_id, ticket_id, should_escalate, needed_tool, CASE WHEN needed_tool IS NULL THEN CASE WHEN len(list_filter(tools, lambda t: t NOT IN ('AnswerDirect', 'AnswerVerify', 'SearchKB', 'GetPolicy'))) = 0 THEN 1.0 ELSE 0.5 END
             WHEN list_contains(tools, needed_tool) THEN 1.0 ELSE 0.0 END AS tool_appropriateness, CASE WHEN (ticket_id IS NOT NULL) = should_escalate THEN 1.0 ELSE 0.0 END AS escalation_accuracy,
           CASE WHEN needed_tool IS NOT NULL THEN list_contains(tools, needed_tool)::INT::DOUBLE END AS tool_name_match, CASE WHEN needed_tool IS NOT NULL THEN list_contains(tools, needed_tool)::INT::DOUBLE END AS tool_arg_f1, query_id % 5 = 0 AS decomposed, query_id % 3 = 0 AS is_multi_part FROM toks""", ("toks",))
relation("m_all", """
    SELECT *, (0.35 * completeness + 0.25 * citation_coverage + CASE WHEN needed_tool IS NOT NULL THEN 0.20 * tool_appropriateness ELSE 0 END + CASE WHEN should_escalate THEN 0.20 * escalation_accuracy ELSE 0 END)
             / (0.60 + CASE WHEN needed_tool IS NOT NULL THEN 0.20 ELSE 0 END + CASE WHEN should_escalate THEN 0.20 ELSE 0 END) AS fcrs
    FROM (SELECT model_tag, query_id, latency_ms, ttft_ms, iterations, confidence FROM resp) JOIN m_recall USING (model_tag, query_id) JOIN m_ground USING (model_tag, query_id) JOIN m_rouge USING (model_tag, query_id) JOIN m_ctx2 USING (model_tag, query_id)
    JOIN m_cf USING (model_tag, query_id) JOIN m_cov USING (model_tag, query_id) JOIN m_comp USING (model_tag, query_id) JOIN m_tool USING (model_tag, query_id)""",
         ("resp", "m_recall", "m_ground", "m_rouge", "m_ctx2", "m_cf", "m_cov", "m_comp", "m_tool"))


@query("recall_at_k", "SELECT model_tag, query_id, round(recall_at_20, 6) AS recall FROM m_recall", ("m_recall",))
def recall_at_k(spark, sf):
    return joined(spark, sf).select(*KEYS, F.round(F.when(F.size("gold_ids") > 0, maths.recall("retrieved", "gold_ids", 20)), 6).alias("recall"))


@query("recall_fallback", """
    SELECT model_tag, query_id, round(CASE WHEN len(gc) = 0 THEN CASE WHEN len(gold_ids) > 0 THEN len(list_intersect(ids, gold_ids)) / len(gold_ids) END
        WHEN len(rc) > 0 THEN len(list_intersect(rc, gc)) / len(gc) WHEN list_has_any(ids, gc) THEN len(list_intersect(ids, gc)) / len(gc)
        WHEN len(gold_ids) > 0 THEN len(list_intersect(ids, gold_ids)) / len(gold_ids) END, 6) AS recall
    FROM (SELECT *, CASE WHEN n = 1 THEN ids ELSE [] END AS rc, CASE WHEN query_id % 2 = 0 THEN gold_ids ELSE [] END AS gc FROM toks)""", ("toks",))
def recall_fallback(spark, sf):
    none = F.array().cast("array<bigint>")
    rc = F.when(F.col("model_tag") == "b1", F.col("retrieved")).otherwise(none)
    gc = F.when(F.col("query_id") % 2 == 0, F.col("gold_ids")).otherwise(none)
    return joined(spark, sf).select(*KEYS, F.round(metrics.recall_with_fallback(rc, F.col("retrieved"), F.col("retrieved"), gc, F.col("gold_ids")), 6).alias("recall"))


@query("grounding_score", "SELECT model_tag, query_id, round(grounding, 6) AS grounding FROM m_ground", ("m_ground",))
def grounding_score(spark, sf):
    ctx = F.array_join(F.transform("citations", lambda c: c["cited_text"]), " ")
    return joined(spark, sf).select(*KEYS, F.round(metrics.grounding("answer", ctx), 6).alias("grounding"))


@query("rouge_n", "SELECT model_tag, query_id, round(p1, 6) AS precision1, round(r1, 6) AS recall1, rouge1, rouge2, ctx_rouge1 FROM m_rouge", ("m_rouge",))
def rouge_n(spark, sf):
    ctx = F.array_join(F.transform("citations", lambda c: c["cited_text"]), " ")
    t = joined(spark, sf).select(*KEYS, tx.tokens_alnum("answer").alias("a"), tx.tokens_alnum("gold_answer").alias("g"), tx.tokens_alnum(ctx).alias("c"))
    one, two, con = metrics.rouge_n("a", "g", 1), metrics.rouge_n("a", "g", 2), metrics.rouge_n("c", "a", 1)
    return t.select(*KEYS, F.round(one["precision"], 6).alias("precision1"), F.round(one["recall"], 6).alias("recall1"), F.round(one["f1"], 4).alias("rouge1"),
                    F.round(two["f1"], 4).alias("rouge2"), F.round(con["recall"], 4).alias("ctx_rouge1"))


@query("rouge_l")
def rouge_l(spark, sf):
    """LCS-based scores on plain and on stemmed tokens (checked against a direct LCS in the tests)."""
    t = joined(spark, sf).select(*KEYS, tx.tokens_alnum("answer").alias("a"), tx.tokens_alnum("gold_answer").alias("g"))
    t = t.withColumns({"sa": metrics.stemmed("a"), "sg": metrics.stemmed("g")})
    plain, stem = metrics.rouge_l("a", "g"), metrics.rouge_l("sa", "sg")
    return t.select(*KEYS, F.round(plain["f1"], 4).alias("rougeL"), F.round(stem["f1"], 4).alias("rougeL_stemmed"))


# A row of the subsequence table per word of the answer: a cell's value is the running maximum of what the words met so far allow.
@query("rouge_l_plain", f"""
    WITH RECURSIVE t AS (SELECT model_tag, query_id, {sql_alnum('answer')} AS a, {sql_alnum('gold_answer')} AS b FROM resp JOIN gold_rows USING (query_id)),
      words AS (SELECT model_tag, query_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w FROM t),
      lcs AS (SELECT model_tag, query_id, 0::BIGINT AS i, b, list_transform(b, lambda x: 0) AS cells FROM t
        UNION ALL
        SELECT model_tag, query_id, i, b, list_transform(best, lambda x, j: list_max(best[1:j])) FROM (
          SELECT model_tag, query_id, words.i, b, list_transform(cells, lambda x, j: CASE WHEN b[j] = w THEN coalesce(cells[j - 1], 0) + 1 ELSE x END) AS best
          FROM lcs JOIN words USING (model_tag, query_id) WHERE words.i = lcs.i + 1))
    SELECT model_tag, query_id, round(CASE WHEN len(a) + len(t.b) > 0 THEN 2 * coalesce(list_last(cells), 0) / (len(a) + len(t.b)) ELSE 0 END, 4) AS "rougeL"
    FROM t JOIN lcs USING (model_tag, query_id) WHERE i = len(a)""", ("resp", "gold_rows"))
def rouge_l_plain(spark, sf):
    """The LCS-based score on plain tokens alone."""
    t = joined(spark, sf).select(*KEYS, tx.tokens_alnum("answer").alias("a"), tx.tokens_alnum("gold_answer").alias("g"))
    return t.select(*KEYS, F.round(metrics.rouge_l("a", "g")["f1"], 4).alias("rougeL"))


@query("span_iou", "SELECT model_tag, query_id, pos::INT AS pos, gi::INT AS gold_pos, round(CASE WHEN c.span_end <= c.span_start THEN 0.0 ELSE ov END, 6) AS iou FROM m_pairs JOIN cites c USING (model_tag, query_id, pos)", ("m_pairs", "cites"))
def span_iou(spark, sf):
    j = joined(spark, sf).select(*KEYS, F.posexplode("citations").alias("pos", "c"), "gold_citations").select(*KEYS, "pos", "c", F.posexplode("gold_citations").alias("gold_pos", "g"))
    return j.filter("c.doc_id = g.doc_id").select(*KEYS, (F.col("pos") + 1).alias("pos"), (F.col("gold_pos") + 1).alias("gold_pos"),
                                                  F.round(maths.span_iou("c.span_start", "c.span_end", "g.span_start", "g.span_end"), 6).alias("iou"))


@query("citation_f1", "SELECT model_tag, query_id, round(citation_precision, 6) AS precision, round(citation_recall, 6) AS recall, round(citation_f1, 6) AS f1 FROM m_cf", ("m_cf",))
def citation_f1(spark, sf):
    s = joined(spark, sf).select(*KEYS, metrics.citation_scores("citations", "gold_citations").alias("s"))
    return s.select(*KEYS, *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query("citation_match_pairs", "SELECT c.model_tag, c.query_id, c.doc_id FROM cites c JOIN gold_cites g ON c.query_id = g.query_id AND c.doc_id = g.doc_id AND c.span_start < g.span_end AND g.span_start < c.span_end", ("cites", "gold_cites"))
def citation_match_pairs(spark, sf):
    """The interval join beneath citation matching: same document (equi-join) and overlapping spans."""
    p = d.responses(spark, sf).select(*KEYS, F.inline("citations"))
    g = d.gold_rows(spark, sf).select("query_id", F.inline("gold_citations")).select("query_id", "doc_id", F.col("span_start").alias("gs"), F.col("span_end").alias("ge"))
    return intervals.overlap_join(p, g, ["query_id", "doc_id"], ("span_start", "span_end"), ("gs", "ge")).select(*KEYS, "doc_id")


@query("tool_accuracy", """
    SELECT event_id, CASE WHEN gold_tool = '' THEN 1.0 ELSE (tool = gold_tool)::INT::DOUBLE END AS name_match, CASE WHEN k % 3 = 0 THEN 0.5 WHEN k % 3 = 1 THEN 1.0 ELSE 0.0 END AS arg_f1
    FROM (SELECT event_id, event_type AS tool, CASE (props->>'$.k')::INT % 4 WHEN 0 THEN '' WHEN 1 THEN 'view' ELSE 'click' END AS gold_tool, (props->>'$.k')::INT AS k FROM events)""")
def tool_accuracy(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    gold_tool = F.when(k % 4 == 0, "").when(k % 4 == 1, "view").otherwise("click")
    pred = F.create_map(F.lit("query"), F.lit(" Pay "), F.lit("top_k"), k.cast("string"))
    gold = F.when(k % 3 == 0, F.create_map(F.lit("query"), F.lit("pay"), F.lit("top_k"), F.lit("x"))).when(k % 3 == 1, F.create_map(F.lit("query"), F.lit("pay"), F.lit("top_k"), k.cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("pay")))
    return table(spark, sf, "events").select("event_id", metrics.tool_name_match(F.array("event_type"), gold_tool).alias("name_match"), metrics.arg_f1(pred, gold).alias("arg_f1"))


@query("binary_prf", """
    SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1
    FROM (SELECT count_if(c >= 0.5 AND quality = 1) AS tp, count_if(c >= 0.5 AND quality = 0) AS fp, count_if(c < 0.5 AND quality = 1) AS fn FROM truth)""", ("truth",))
def binary_prf(spark, sf):
    return truth(spark, sf).agg(*[F.round(c, 6).alias(n) for n, c in evaluate.binary_prf(F.col("c") >= 0.5, F.col("quality") == 1).items()])


relation("truth", "SELECT doc_id, quality, ('0x' || left(md5(doc_id::VARCHAR), 4))::INT / 65535.0::DOUBLE AS c, 'm' || toxic AS tag FROM labels")


def truth(spark, sf):
    c = F.conv(F.left(F.md5(F.col("doc_id").cast("string")), F.lit(4)), 16, 10).cast("double") / 65535.0
    return table(spark, sf, "labels").select("doc_id", "quality", c.alias("c"), F.concat(F.lit("m"), F.col("toxic").cast("string")).alias("tag"))


@query("decomp_eval", "SELECT conv_id, turn, len(subs) > 1 AS is_multi_part, (len(subs) > 1) = (v < 4) AS correct FROM subs", ("subs",))
def decomp_eval(spark, sf):
    from askloom.plans.q_text import asked
    multi = F.size(tx.split_sub_queries("text")) > 1
    return asked(spark, sf).select("conv_id", "turn", multi.alias("is_multi_part"), (multi == (F.col("v") < 4)).alias("correct"))


@query("consistency", f"""
    SELECT source, max(n) / sum(n) AS consistency FROM (SELECT source, array_to_string({sql_alnum('text')}, ' ') AS f, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def consistency(spark, sf):
    return evaluate.consistency(d.corpus(spark, sf), "source", "text")


@query("loop_efficiency", "SELECT event_type, CASE WHEN max(i) > 0 THEN round(avg(i), 6) END AS efficiency FROM (SELECT event_type, CASE WHEN event_type = 'view' THEN 0 ELSE (props->>'$.k')::INT % 3 END AS i FROM events) GROUP BY 1")
def loop_efficiency(spark, sf):
    i = F.when(F.col("event_type") == "view", 0).otherwise(F.get_json_object("props", "$.k").cast("int") % 3)
    return table(spark, sf, "events").select("event_type", i.alias("i")).groupBy("event_type").agg(F.round(evaluate.loop_efficiency("i"), 6).alias("efficiency"))


@query("factual_sentence", f"SELECT doc_id, count_if({_FACT}) AS n_factual, count(*) AS n FROM (SELECT doc_id, unnest({sql_sentences('text')}) AS s FROM documents) GROUP BY doc_id")
def factual_sentence(spark, sf):
    s = d.corpus(spark, sf).select("doc_id", tx.sentences("text").alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size(F.filter("s", metrics.factual)).alias("n_factual"), F.size("s").alias("n"))


@query("citation_coverage", "SELECT model_tag, query_id, round(citation_coverage, 6) AS coverage FROM m_cov", ("m_cov",))
def citation_coverage(spark, sf):
    return joined(spark, sf).select(*KEYS, F.round(metrics.citation_coverage("answer", "citations", "gold_ids"), 6).alias("coverage"))


@query("tool_appropriateness", "SELECT model_tag, query_id, tool_appropriateness, escalation_accuracy FROM m_tool", ("m_tool",))
def tool_appropriateness(spark, sf):
    return joined(spark, sf).select(*KEYS, metrics.tool_appropriateness("tools", "needed_tool").alias("tool_appropriateness"), metrics.escalation_accuracy("ticket_id", "should_escalate").alias("escalation_accuracy"))


@query("completeness", "SELECT model_tag, query_id, round(completeness, 6) AS completeness FROM m_comp", ("m_comp",))
def completeness(spark, sf):
    return joined(spark, sf).select(*KEYS, F.round(metrics.completeness("answer", tx.sentences("gold_answer")), 6).alias("completeness"))


EVAL = ("recall_at_20", "grounding", "citation_f1", "citation_precision", "citation_recall", "rouge1", "rouge2", "ctx_rouge1", "ctx_rouge2", "completeness", "citation_coverage",
        "tool_name_match", "tool_arg_f1", "tool_appropriateness", "escalation_accuracy", "fcrs")


def per_query(spark, sf):
    k = F.col("query_id")
    return evaluate.per_query(d.responses(spark, sf).withColumn("decomposed", k % 5 == 0), d.gold_rows(spark, sf).withColumn("is_multi_part", k % 3 == 0))


@query("fcrs", "SELECT model_tag, query_id, round(fcrs, 6) AS fcrs FROM m_all", ("m_all",))
def fcrs(spark, sf):
    return per_query(spark, sf).select(*KEYS, F.round("fcrs", 6).alias("fcrs"))


@query("eval_per_query", "SELECT model_tag, query_id, latency_ms, ttft_ms, iterations, " + ", ".join(f"round({c}, 6) AS {c}" for c in EVAL) + " FROM m_all", ("m_all",))
def eval_per_query(spark, sf):
    return per_query(spark, sf).select(*KEYS, "latency_ms", "ttft_ms", "iterations", *[F.round(c, 6).alias(c) for c in EVAL])


relation("m_sum", "SELECT model_tag, count(*) AS n_queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in EVAL) + """, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(avg(latency_ms), 6) AS latency_mean,
    round(quantile_cont(ttft_ms, 0.5), 6) AS ttft_p50, round(quantile_cont(ttft_ms, 0.95), 6) AS ttft_p95, CASE WHEN max(iterations) > 0 THEN round(avg(iterations), 6) END AS loop_efficiency,
    round(2 * count_if(ticket_id IS NOT NULL AND should_escalate) / (2 * count_if(ticket_id IS NOT NULL AND should_escalate) + count_if((ticket_id IS NOT NULL) <> should_escalate)), 6) AS escalation_f1,
    round(2 * count_if(decomposed AND is_multi_part) / (2 * count_if(decomposed AND is_multi_part) + count_if(decomposed <> is_multi_part)), 6) AS decomposition_f1 FROM m_all GROUP BY model_tag""", ("m_all",))
SUMMARY = (*EVAL, "latency_p50", "latency_p95", "latency_mean", "ttft_p50", "ttft_p95", "loop_efficiency", "escalation_f1", "decomposition_f1")


def summary(spark, sf):
    return evaluate.aggregate(per_query(spark, sf)).select("model_tag", "n_queries", *[F.round(c, 6).alias(c) for c in SUMMARY])


@query("eval_aggregate", "SELECT model_tag, n_queries, " + ", ".join(SUMMARY) + " FROM m_sum", ("m_sum",))
def eval_aggregate(spark, sf):
    return summary(spark, sf)


@query("eval_all_models", " UNION ALL ".join(f"SELECT '{c}' AS metric, max({c}) FILTER (WHERE model_tag = 'b1') AS b1, max({c}) FILTER (WHERE model_tag = 'b2') AS b2, max({c}) FILTER (WHERE model_tag = 'b3') AS b3 FROM m_sum" for c in ("recall_at_20", "grounding", "citation_f1", "fcrs")), ("m_sum",))
def eval_all_models(spark, sf):
    return evaluate.wide_form(evaluate.long_form(summary(spark, sf), ["recall_at_20", "grounding", "citation_f1", "fcrs"]), ["b1", "b2", "b3"])


@query("ablation_delta", "SELECT model_tag, fcrs, round(fcrs - (SELECT fcrs FROM m_sum WHERE model_tag = 'b3'), 6) AS delta FROM m_sum", ("m_sum",))
def ablation_delta(spark, sf):
    return evaluate.ablation(summary(spark, sf), "b3").withColumn("delta", F.round("delta", 6))


def sql_unit(key: str) -> str:
    return f"(('0x' || substr(md5({key} || '|42'), 1, 8))::BIGINT / 4294967296.0)"


relation("bnum", "SELECT model_tag, d, row_number() OVER (PARTITION BY model_tag ORDER BY event, d) - 1 AS pos, count(*) OVER (PARTITION BY model_tag) AS n FROM bdiff WHERE d IS NOT NULL", ("bdiff",))
relation("bdraws", f"""
    SELECT model_tag, n, rep, CASE WHEN n <= {evaluate.BLOCK} THEN 0 ELSE floor({sql_unit("pos || ':' || rep")} * n)::BIGINT // {evaluate.BLOCK} END AS block, count(*) AS c
    FROM bnum, (SELECT unnest(range(1, 1001)) AS rep) GROUP BY ALL""", ("bnum",))
relation("boot", f"""
    SELECT model_tag, avg((abs(m - o) >= abs(o))::INT) AS p_value FROM (
      SELECT model_tag, rep, sum(d) / any_value(n) AS m FROM (
        SELECT model_tag, rep, block * {evaluate.BLOCK} + floor({sql_unit("block || ':' || t || ':' || rep")} * least({evaluate.BLOCK}, n - block * {evaluate.BLOCK}))::BIGINT AS pos
        FROM (SELECT model_tag, n, rep, block, unnest(range(1, c + 1)) AS t FROM bdraws))
      JOIN bnum USING (model_tag, pos) GROUP BY model_tag, rep) JOIN (SELECT model_tag, avg(d) AS o FROM bnum GROUP BY 1) USING (model_tag) GROUP BY model_tag""", ("bnum", "bdraws"))
# Per-query values for significance: mean event value per user and event type.
relation("bval", "SELECT event_type AS model_tag, user_id AS event, round(avg(value), 6) AS v FROM events GROUP BY ALL")
relation("bdiff", "SELECT a.model_tag, a.event, a.v - b.v AS d FROM bval a JOIN bval b ON a.event = b.event AND b.model_tag = 'click' WHERE a.model_tag <> 'click'", ("bval",))


def p_values(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("model_tag"), F.col("user_id").alias("query_id")).agg(F.round(F.avg("value"), 6).alias("fcrs"))
    return evaluate.bootstrap_p(rows, "click")


@query("bootstrap_p", "SELECT model_tag, round(p_value, 6) AS p_value FROM boot", ("boot",))
def bootstrap_p(spark, sf):
    return p_values(spark, sf).withColumn("p_value", F.round("p_value", 6))


@query("significance_flags", "SELECT model_tag, p_value < 0.05 AS significant FROM boot", ("boot",))
def significance_flags(spark, sf):
    return evaluate.significance(p_values(spark, sf)).select("model_tag", "significant")


_EDGES = [i * (1.0 / 10) for i in range(1, 11)]


def sql_bin(c: str) -> str:
    return "least(" + " + ".join(f"({c} >= {e!r}::DOUBLE)::INT" for e in _EDGES) + ", 9)"


def sql_ece(c: str, rel: str, y: str = "quality") -> str:
    return f"(SELECT sum(n * abs(a - m)) / sum(n) FROM (SELECT {sql_bin(c)} AS b, count(*) AS n, avg({y}) AS a, avg({c}) AS m FROM {rel} GROUP BY 1))"


@query("ece", f"SELECT tag, round(sum(n * abs(a - m)) / sum(n), 6) AS ece FROM (SELECT tag, {sql_bin('c')} AS b, count(*) AS n, avg(quality) AS a, avg(c) AS m FROM truth GROUP BY 1, 2) GROUP BY tag", ("truth",))
def ece(spark, sf):
    return calibrate.ece(truth(spark, sf), ["tag"], "c", "quality").withColumn("ece", F.round("ece", 6))


@query("reliability_bins", f"""
    SELECT tag, bin, coalesce(n, 0) AS n, coalesce(round(a, 6), 0) AS accuracy, coalesce(round(m, 6), 0) AS confidence
    FROM (SELECT tag, unnest(range(0, 10))::INT AS bin FROM (SELECT tag FROM truth GROUP BY tag HAVING count(*) >= 10))
    LEFT JOIN (SELECT tag, {sql_bin('c')} AS bin, count(*) AS n, avg((c * 0.9 + quality * 0.1 >= 0.7)::INT) AS a, avg(c) AS m FROM truth GROUP BY 1, 2) USING (tag, bin)""", ("truth",))
def reliability_bins(spark, sf):
    t = truth(spark, sf).withColumn("q", F.col("c") * 0.9 + F.col("quality") * 0.1)
    return calibrate.reliability_bins(t, "tag", "c", "q").withColumns({"accuracy": F.round("accuracy", 6), "confidence": F.round("confidence", 6)})


relation("logits", "SELECT doc_id, tag, quality, c, ln(least(greatest(c, 1e-6), 1 - 1e-6) / (1 - least(greatest(c, 1e-6), 1 - 1e-6))) AS z FROM truth", ("truth",))


def logits(spark, sf):
    return truth(spark, sf).withColumn("z", maths.logit(F.col("c")))


def sql_temperature(loss: str, steps: int = 51) -> str:
    return f"""SELECT tag, arg_min(t, (l, t)) AS temperature FROM (SELECT tag, t, round(avg({loss}), 9) AS l FROM logits, (SELECT round(0.5 + i * {2.5 / (steps - 1)!r}, 6) AS t FROM (SELECT unnest(range(0, {steps})) AS i)) GROUP BY tag, t) GROUP BY tag"""


_SP = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_NLL = f"quality * {_SP.format(x='(-z / t)')} + (1 - quality) * {_SP.format(x='(z / t)')}"


@query("temperature_grid", sql_temperature(_NLL), ("logits",))
def temperature_grid(spark, sf):
    return calibrate.temperature_binary(logits(spark, sf), ["tag"], "z", "quality").select("tag", "temperature")


@query("temperature_grid_multiclass", sql_temperature("-([z, 0.3, -0.2][quality + 1] / t - greatest(z, 0.3) / t - ln(exp(z / t - greatest(z, 0.3) / t) + exp(0.3 / t - greatest(z, 0.3) / t) + exp(-0.2 / t - greatest(z, 0.3) / t)))"), ("logits",))
def temperature_grid_multiclass(spark, sf):
    l3 = logits(spark, sf).withColumn("l3", F.array(F.col("z"), F.lit(0.3), F.lit(-0.2)))
    return calibrate.temperature_multiclass(l3, ["tag"], "l3", "quality").select("tag", "temperature")


@query("temperature_grid_mse", sql_temperature("(1 / (1 + exp(-z / t)) - quality) ** 2", 26), ("logits",))
def temperature_grid_mse(spark, sf):
    return calibrate.temperature_mse(logits(spark, sf), ["tag"], "z", "quality").select("tag", "temperature")


_AUC = "(SELECT (sum(CASE WHEN quality = 1 THEN r ELSE 0 END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2) / (count_if(quality = 1) * count_if(quality = 0)) FROM (SELECT quality, row_number() OVER (ORDER BY c, doc_id) AS r FROM truth))"


@query("auroc", f"SELECT round({_AUC}, 6) AS auroc", ("truth",))
def auroc(spark, sf):
    return calibrate.auroc(truth(spark, sf), "c", "quality", "doc_id").withColumn("auroc", F.round("auroc", 6))


relation("one_t", f"SELECT temperature AS t FROM ({sql_temperature(_NLL).replace('tag, ', '').replace('GROUP BY tag', '').replace('GROUP BY t)', 'GROUP BY t)')})".replace("GROUP BY tag, t", "GROUP BY t"), ("logits",))
relation("scaled", "SELECT quality, 1 / (1 + exp(-z / (SELECT t FROM one_t))) AS s FROM logits", ("logits", "one_t"))


@query("calibration_report", f"""
    SELECT 'm5' AS model_tag, (SELECT count(*) FROM truth) AS n, (SELECT t FROM one_t) AS temperature, round({sql_ece('c', 'truth')}, 6) AS ece_before, round({sql_ece('s', 'scaled')}, 6) AS ece_after, round({_AUC}, 6) AS auroc""",
       ("truth", "one_t", "scaled"))
def calibration_report(spark, sf):
    r = calibrate.calibration_report(truth(spark, sf), "c", "quality", "doc_id", "m5")
    return r.select("model_tag", "n", "temperature", *[F.round(c, 6).alias(c) for c in ("ece_before", "ece_after", "auroc")])


@query("latency_bench", """
    SELECT model_tag, n AS n_queries, round(s / n, 6) AS avg_latency_ms, round(n / (s / 1000.0), 6) AS throughput_qps, round(c, 6) AS avg_confidence, round(ret, 6) AS avg_retrieval_ms, coalesce(round(gen, 6), 0) AS avg_generation_ms,
           l[round_even(0.50 * (n - 1), 0)::INT + 1] AS p50_latency_ms, l[round_even(0.95 * (n - 1), 0)::INT + 1] AS p95_latency_ms, l[round_even(0.99 * (n - 1), 0)::INT + 1] AS p99_latency_ms
    FROM (SELECT event_type AS model_tag, count(*) AS n, sum(value) AS s, avg((props->>'$.k')::INT / 100) AS c, list(value ORDER BY value) AS l, avg(value * 0.3 * 2) FILTER (WHERE value > 0) AS ret, avg(value * 0.5) FILTER (WHERE event_type <> 'view' AND value > 0) AS gen FROM events GROUP BY 1)""")
def latency_bench(spark, sf):
    call = lambda t, v: F.struct(F.lit(t).alias("tool_name"), v.alias("latency_ms"))
    v = F.col("value")
    e = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model_tag"), v.alias("latency_ms"), (F.get_json_object("props", "$.k").cast("int") / 100).alias("confidence"),
        F.array(call("SearchKB", v * 0.3), call("SearchKB", v * 0.3), call("AnswerDirect", F.when(F.col("event_type") != "view", v * 0.5))).alias("tool_calls"))
    out = audit.latency_bench(e, "event_id")
    return out.select("model_tag", "n_queries", *[F.round(c, 6).alias(c) for c in ("avg_latency_ms", "throughput_qps", "avg_confidence", "avg_retrieval_ms", "avg_generation_ms")], "p50_latency_ms", "p95_latency_ms", "p99_latency_ms")


@query("audit_stats", """
    SELECT event_type AS tag, grouping(event_type)::INT AS is_total, count(*) AS n, round(avg(value), 6) AS avg_latency_ms, round(avg((props->>'$.k')::INT / 100), 6) AS avg_confidence, count_if(event_type = 'error') AS escalations
    FROM events GROUP BY ROLLUP (event_type)""")
def audit_stats(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_type").alias("model_tag"), F.col("value").alias("latency_ms"), (F.get_json_object("props", "$.k").cast("int") / 100).alias("confidence"),
                                          F.when(F.col("event_type") == "error", "T").alias("ticket_id"))
    return audit.audit_stats(a).withColumns({"avg_latency_ms": F.round("avg_latency_ms", 6), "avg_confidence": F.round("avg_confidence", 6)})


@query("inverse_freq_weights", """
    SELECT event_id, b AS bucket, round((SELECT max(n) FROM (SELECT count(*) AS n FROM x GROUP BY b)) / count(*) OVER (PARTITION BY b), 6) AS weight FROM x""", ("x",))
def inverse_freq_weights(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") / 100).alias("alpha"))
    return audit.inverse_frequency_weights(e, "alpha").select("event_id", "bucket", F.round("weight", 6).alias("weight"))


relation("x", "SELECT event_id, least(floor((props->>'$.k')::INT / 100 * 5), 4)::INT AS b FROM events")


@query("fit_alpha_model")
def fit_alpha_model(spark, sf):
    """Fusion weights for held-out questions, learned from the weights that retrieve their gold documents best."""
    q = d.queries(spark, sf).join(d.query_vectors(spark, sf), "query_id", "left")
    norm = F.sqrt(F.aggregate(F.coalesce("embedding", F.array().cast("array<float>")), F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    f = features.features12("text", "role", F.col("norm"))
    rows = q.withColumns({"role": F.lit("user"), "norm": norm}).select("query_id", *[c.alias(n) for n, c in f.items()])
    best = labels.alpha_oracle(d.hybrid_candidates(spark, sf), d.gold(spark, sf), balanced=True).select("query_id", F.col("optimal_alpha").alias("label"))
    # a fit reads its rows many times: the label's retrieval is done once
    return models.fit_alpha(staged(rows.join(best, "query_id"), "alpha-rows"), list(features.NAMES12), "label", "query_id", fixed.ALPHA_MIN, fixed.ALPHA_MAX)[1]


@query("fit_confidence_model")
def fit_confidence_model(spark, sf):
    """Confidence learned from how far the best document covers the question's text, with the error on held-out questions."""
    q, top = d.query_vectors(spark, sf), staged(d.dense_top(spark, sf, 5), "top")
    ev = labels.mean_pool(top, d.vectors(spark, sf), q.select("query_id"), 64)
    first = retrieve.with_texts(top.filter("rank = 1").select("query_id", "doc_id"), d.corpus(spark, sf), d.queries(spark, sf), 1)
    soft = first.select("query_id", maths.clip(retrieve.lexical_scorer(F.col("query_text"), F.col("doc_text")) * 1.25, 0, 1).alias("soft"))
    rows = staged(q.join(ev, "query_id").join(soft, "query_id"), "confidence-rows")
    return models.fit_confidence(rows, "embedding", "evidence", "soft", "query_id")[1].select("query_id", "soft", "confidence", "held_out", "abs_error")


@query("fit_tool_policy")
def fit_tool_policy(spark, sf):
    """The tool that each labelled document's labels ask for, learned from its vector; right or wrong on held-out rows."""
    lab = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2).alias("tool"))
    rows = staged(d.vectors(spark, sf).join(lab, "doc_id"), "tool-rows")
    return models.fit_classifier(rows, "embedding", "tool", "doc_id", multinomial=True)[1].select(
        "doc_id", "tool", F.col("prediction").cast("int").alias("predicted"), "held_out", "correct")


@query("fit_decomp_classifier")
def fit_decomp_classifier(spark, sf):
    """Which questions have several parts, by the words of the text, learned from the vector; right or wrong on held-out rows."""
    lab = d.corpus(spark, sf).select("doc_id", tx.multi_part_by_word("text").cast("int").alias("multi")).filter("multi IS NOT NULL")
    rows = staged(d.vectors(spark, sf).join(lab, "doc_id"), "decomp-rows")
    return models.fit_classifier(rows, "embedding", "multi", "doc_id")[1].select(
        "doc_id", "multi", F.round(F.get("probs", F.lit(1)), 4).alias("p_multi"), "held_out", "correct")
