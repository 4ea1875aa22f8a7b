"""Routing, verification, escalation, merging, and the retry loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.operators import decompose, features, index, responses, retrieve, routing, tools, variants
from askloom.plans import domain as d
from askloom.plans.domain import sql_alnum, sql_any, sql_content, sql_list, sql_sentences, sql_strip
from askloom.plans.registry import query, relation
from askloom.sources.tables import table
from askloom.util import broadcast_if, scratch_dir, staged

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


# Confidence of a query: 0.3 times its best rerank score (queries without candidates have none).
relation("conf", "SELECT query_id, round(0.3 * max(score), 6) AS confidence FROM rerank GROUP BY query_id", ("rerank",))


def confidences(ranked):
    return ranked.groupBy("query_id").agg(F.round(0.3 * F.max("score"), 6).alias("confidence"))


@query("route_tier", """
    SELECT query_id, confidence, CASE WHEN confidence IS NULL THEN 'ticket' WHEN confidence >= 0.20 THEN 'answer' WHEN confidence >= 0.15 THEN 'answer_verify'
           WHEN confidence >= 0.10 THEN 'tool_retry' ELSE 'ticket' END AS action FROM q LEFT JOIN conf USING (query_id)""", ("q", "conf"))
def route_tier(spark, sf):
    return d.queries(spark, sf).select("query_id").join(confidences(d.reranked(spark, sf)), "query_id", "left").withColumn("action", routing.route_tier("confidence"))


@query("mid_tier_tool", "SELECT event_id, CASE WHEN value * 0.6 > (props->>'$.k')::INT * 0.3 THEN 'GetPolicy' ELSE 'SearchKB' END AS tool FROM events")
def mid_tier_tool(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    probs = F.array(F.lit(0.1), k * 0.3, F.col("value") * 0.6, F.lit(0.1))
    return table(spark, sf, "events").select("event_id", routing.mid_tier_tool(probs).alias("tool"))


# Responses to verify: the answers of the question/answer pairs with two cited texts each.
relation("claims", rf"""
    SELECT qa_id, c.answer, qa.chunk AS t1, qa.query AS t2, v, substr(md5(qa_id), 1, 8) AS d1 FROM cited c JOIN qa USING (qa_id)""", ("cited", "qa"))
relation("judged", rf"""
    SELECT qa_id, v, count(*) AS n, avg((p >= 0.5)::INT) AS g FROM (
      SELECT qa_id, v, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END AS p FROM (
        SELECT qa_id, v, {sql_alnum('s')} AS a, {sql_alnum("CASE WHEN doc = d1 THEN t1 WHEN doc = 'doc-' || v || '_x' THEN t2 ELSE t1 || ' ' || t2 END")} AS b FROM (
          SELECT qa_id, v, t1, t2, d1, regexp_extract(raw, '\[([^\]:]+):(\d+)-(\d+)\]', 1) AS doc, {sql_strip(r"regexp_replace(raw, '\[([^\]:]+):(\d+)-(\d+)\]', '', 'g')")} AS s
          FROM (SELECT qa_id, v, t1, t2, d1, unnest({sql_sentences('answer')}) AS raw FROM claims WHERE v <> 5)) WHERE s <> ''))
    GROUP BY qa_id, v""", ("claims",))


@query("verify_answers", """
    SELECT qa_id, CASE WHEN v = 5 THEN 'skipped' WHEN v = 4 OR g IS NULL THEN 'fail' WHEN g >= 0.30 THEN 'pass' WHEN g >= 0.20 THEN 'partial' ELSE 'fail' END AS verdict,
           CASE WHEN v = 5 THEN NULL WHEN v = 4 THEN 0.0 ELSE round(coalesce(g, 0), 6) END AS grounding_score, CASE WHEN v = 5 THEN 0 ELSE coalesce(n, 0) END AS n_sentences
    FROM claims LEFT JOIN (SELECT qa_id, n, g FROM judged) USING (qa_id)""", ("claims", "judged"))
def verify_answers(spark, sf):
    from askloom.plans.q_text import cited
    h = F.substring(F.md5("qa_id"), 1, 8)
    base = cited(spark, sf).join(d.qa(spark, sf).select("qa_id", "chunk", "query"), "qa_id")
    ans = base.select("qa_id", "answer", F.when(F.col("v") == 5, 0.9).otherwise(0.1).alias("confidence"))
    two = F.array(F.struct(h.alias("doc_id"), F.lit(1).alias("rank"), F.col("chunk").alias("cited_text")),
                  F.struct(F.concat(F.lit("doc-"), F.col("v").cast("string"), F.lit("_x")).alias("doc_id"), F.lit(2).alias("rank"), F.col("query").alias("cited_text")))
    cites = base.filter("v <> 4").select("qa_id", F.inline(two))
    out = routing.verify_answers(ans, cites, "qa_id", confidence="confidence")
    return out.withColumn("grounding_score", F.round("grounding_score", 6))


@query("verify_relax", """
    SELECT event_id, round(greatest(0.10, 0.30 - 0.15 * i), 6) AS pass, round(greatest(0.05, 0.20 - 0.15 * i), 6) AS partial, round(greatest(0.10, 0.50 - 0.15 * i), 6) AS entail
    FROM (SELECT event_id, (props->>'$.k')::INT % 4 AS i FROM events)""")
def verify_relax(spark, sf):
    th = routing.verify_thresholds(F.get_json_object("props", "$.k").cast("int") % 4)
    return table(spark, sf, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in th.items()])


@query("softmax3", """
    SELECT event_id, [round(exp(a - m) / s, 6), round(exp(b - m) / s, 6), round(exp(c - m) / s, 6)] AS probs, round(exp(c - m) / s, 6) AS entail
    FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS s FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT event_id, value / 10 AS a, (props->>'$.k')::INT / 20 AS b, 1.5::DOUBLE AS c FROM events)))""")
def softmax3(spark, sf):
    logits = F.array(F.col("value") / 10, F.get_json_object("props", "$.k").cast("int") / 20, F.lit(1.5))
    p = table(spark, sf, "events").select("event_id", F.transform(maths.softmax(logits), lambda x: F.round(x, 6)).alias("probs"))
    return p.withColumn("entail", F.get("probs", F.lit(2)))


@query("confidence_soft_label", f"""
    SELECT qa_id, round(greatest(0, least(1, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END * 1.25)), 6) AS soft_label
    FROM (SELECT qa_id, {sql_alnum('chunk')} AS a, {sql_alnum('answer')} AS b FROM qa)""", ("qa",))
def confidence_soft_label(spark, sf):
    s = retrieve.lexical_scorer(F.col("chunk"), F.col("answer")) * 1.25
    return d.qa(spark, sf).select("qa_id", F.round(maths.clip(s, 0, 1), 6).alias("soft_label"))


def sql_ticket(key: str, text: str, reason: str) -> str:
    tid = f"'TKT-' || upper(substr(sha256({key}::VARCHAR), 1, 10))"
    return f"""{tid} AS ticket_id, {text} AS query, {reason} AS summary, 'other' AS category, 'medium' AS severity, {reason} AS evidence_gap, '24h' AS estimated_response_time,
           TIMESTAMP '2024-02-01' AS created_at, 'No confident answer was found. A specialist will follow up (ticket ' || {tid} || ', within 24h).' AS message"""


@query("escalate", f"SELECT query_id, {sql_ticket('query_id', 'text', chr(39) + 'low_confidence' + chr(39))} FROM q LEFT JOIN conf USING (query_id) WHERE confidence IS NULL OR confidence < 0.20", ("q", "conf"))
def escalate(spark, sf):
    c = d.queries(spark, sf).join(confidences(d.reranked(spark, sf)), "query_id", "left")
    return tools.escalate(c.filter("confidence IS NULL OR confidence < 0.20"), now())


# A user's own collection: the vectors of documents in one language, with an answer per query.
relation("udoc", """
    SELECT query_id, text, doc_id, score, rank, CASE WHEN query_id % 3 = 0 THEN 'The text does not contain it.' ELSE text END AS answer FROM (
      SELECT query_id, vec_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, qv WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')))
    JOIN q USING (query_id) WHERE rank <= 5 AND score >= 0.30""", ("qv", "q"))


@query("user_docs_answers", f"""
    WITH outcome AS (SELECT q.query_id, q.text, any_value(answer) AS answer, count(doc_id) AS n_hits FROM q LEFT JOIN udoc USING (query_id) WHERE q.query_id IN (SELECT query_id FROM qv) GROUP BY ALL)
    SELECT query_id, 'answer' AS outcome, answer, n_hits, NULL AS ticket_id FROM outcome WHERE n_hits > 0 AND NOT {sql_any('answer', fixed.OUT_OF_SCOPE_PHRASES)}
    UNION ALL SELECT query_id, 'ticket', NULL, 0, 'TKT-' || upper(substr(sha256(query_id::VARCHAR), 1, 10)) FROM outcome WHERE NOT (n_hits > 0 AND NOT {sql_any("coalesce(answer, 'no information')", fixed.OUT_OF_SCOPE_PHRASES)})""", ("q", "udoc", "qv"))
def user_docs_answers(spark, sf):
    from askloom.operators.userdocs import answer_from_collection
    coll = d.corpus(spark, sf).filter("lang <> 'en'").select("doc_id", "text")
    qv = d.query_vectors(spark, sf)
    q = d.queries(spark, sf).join(qv.select("query_id"), "query_id", "left_semi")
    answer = F.when(F.col("query_id") % 3 == 0, "The text does not contain it.").otherwise(F.col("text"))
    return answer_from_collection(q, qv, d.vectors(spark, sf), coll, answer, now()).select("query_id", "outcome", "answer", "n_hits", "ticket_id")


# Every user's own collection at once: documents and questions belong to the user their number gives.
relation("udocs", """
    SELECT query_id, text, doc_id, score, rank, CASE WHEN query_id % 3 = 0 THEN 'The text does not contain it.' ELSE text END AS answer FROM (
      SELECT query_id, vec_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, qv WHERE vec_id % 7 = query_id % 7 AND vec_id IN (SELECT doc_id FROM documents)))
    JOIN q USING (query_id) WHERE rank <= 5 AND score >= 0.30""", ("qv", "q"))


@query("user_docs_many", f"""
    WITH outcome AS (SELECT q.query_id, q.text, any_value(answer) AS answer, count(doc_id) AS n_hits FROM q LEFT JOIN udocs USING (query_id) WHERE q.query_id IN (SELECT query_id FROM qv) GROUP BY ALL)
    SELECT query_id, 'answer' AS outcome, answer, n_hits, NULL AS ticket_id FROM outcome WHERE n_hits > 0 AND NOT {sql_any('answer', fixed.OUT_OF_SCOPE_PHRASES)}
    UNION ALL SELECT query_id, 'ticket', NULL, 0, 'TKT-' || upper(substr(sha256(query_id::VARCHAR), 1, 10)) FROM outcome WHERE NOT (n_hits > 0 AND NOT {sql_any("coalesce(answer, 'no information')", fixed.OUT_OF_SCOPE_PHRASES)})""", ("q", "udocs", "qv"))
def user_docs_many(spark, sf):
    from askloom.operators.userdocs import answer_from_collections
    user = lambda c: (F.col(c) % 7).alias("collection")
    qv = d.query_vectors(spark, sf)
    q = d.queries(spark, sf).join(qv.select("query_id"), "query_id", "left_semi").select("query_id", "text", user("query_id"))
    members = d.corpus(spark, sf).select(user("doc_id"), "doc_id")
    answer = F.when(F.col("query_id") % 3 == 0, "The text does not contain it.").otherwise(F.col("text"))
    return answer_from_collections(q, qv, d.vectors(spark, sf), members, answer, now()).select("query_id", "outcome", "answer", "n_hits", "ticket_id")


# Sub-responses: the turns of a conversation answered one by one and merged per conversation.
relation("subr", f"""
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM (
      SELECT conv_id, turn, query, answer, v, qa_id, round(((turn * 7 + conv_id) % 10) / 10, 6) AS confidence, (turn % 3)::INT AS iterations,
             CASE WHEN v = 2 THEN 'TKT-' || qa_id END AS ticket_id, CASE WHEN v > 3 THEN v / 10 END AS alpha, 10.0 * (turn + 1) AS latency_ms, CASE WHEN v <> 1 THEN turn + 0.5 END AS ttft_ms,
             {sql_list(('contradiction', 'neutral', 'entailment', 'Entailment'))}[v + 1] AS verdict, CASE WHEN v % 2 = 0 THEN '' ELSE 'm5' END AS model_tag FROM qa)""", ("qa",))


@query("decompose_merge", f"""
    SELECT conv_id, string_agg('For [' || query || ']:' || chr(10) || {sql_strip('answer')}, chr(10) || chr(10) ORDER BY turn) AS answer,
           list_distinct(list('c' || v))::VARCHAR[] AS cited, list('SearchKB-' || turn ORDER BY turn) AS calls, list(query ORDER BY turn) AS sub_queries, min(confidence) AS confidence, max(iterations) AS iterations,
           arg_min(ticket_id, turn) FILTER (WHERE ticket_id IS NOT NULL) AS ticket_id, round(avg(alpha), 6) AS alpha, sum(latency_ms)::DOUBLE AS latency_ms, min(ttft_ms)::DOUBLE AS ttft_ms,
           coalesce(arg_min(model_tag, turn) FILTER (WHERE model_tag <> ''), '') AS model_tag,
           CASE WHEN bool_or(verdict = 'contradiction') THEN 'contradiction' WHEN bool_or(verdict = 'neutral') THEN 'neutral' WHEN bool_or(lower(verdict) = 'entailment') THEN 'entailment' END AS verify_verdict
    FROM subr GROUP BY conv_id""".replace("list_distinct(list('c' || v))::VARCHAR[]", "list_sort(list_distinct(list('c' || v)))"), ("subr",))
def decompose_merge(spark, sf):
    v, t = F.col("v"), F.col("turn")
    cite = F.struct(F.lit("d").alias("doc_id"), F.concat(F.lit("c"), v.cast("string")).alias("chunk_id"))
    r = d.qa(spark, sf).select(
        "conv_id", t.alias("pos"), "answer", F.array("query").alias("sub_queries"), F.array(cite, cite).alias("citations"), F.array(F.concat(F.lit("SearchKB-"), t.cast("string"))).alias("tool_calls"),
        F.round(((t * 7 + F.col("conv_id")) % 10) / 10, 6).alias("confidence"), (t % 3).cast("int").alias("iterations"), F.when(v == 2, F.concat(F.lit("TKT-"), "qa_id")).alias("ticket_id"),
        F.when(v > 3, v / 10).alias("alpha"), (10.0 * (t + 1)).alias("latency_ms"), F.when(v != 1, t + 0.5).alias("ttft_ms"),
        F.get(F.array(*[F.lit(x) for x in ("contradiction", "neutral", "entailment", "Entailment")]), v).alias("verify_verdict"), F.when(v % 2 == 0, "").otherwise("m5").alias("model_tag"))
    m = decompose.merge_responses(r, "conv_id")
    return m.select("conv_id", "answer", F.array_sort(F.transform("citations", lambda c: c["chunk_id"])).alias("cited"), F.col("tool_calls").alias("calls"), "sub_queries", "confidence", "iterations",
                    "ticket_id", F.round("alpha", 6).alias("alpha"), "latency_ms", "ttft_ms", "model_tag", "verify_verdict")


def loop_parts(spark, sf):
    """The callables of the action loop over the test tables: BM25, lexical reranking, lexical verification."""
    docs, path = d.corpus(spark, sf), scratch_dir(spark, "index")
    index.save_index(d.lexical(spark, sf), path)  # every round reads it
    ix = index.load_index(spark, path, "doc_id")

    def find(qs):
        return retrieve.bm25_topk(qs, ix, 20)

    def rerank(found, qs):
        return retrieve.rerank_topk(retrieve.with_texts(found, docs, qs, 20), 10).select("query_id", "doc_id", "score", "rank")

    def verify(tier, ranked, it):
        top = docs.select("doc_id", F.col("text").alias("cited_text")).join(broadcast_if(ranked.filter("rank <= 3").select("query_id", "doc_id", "rank"), d.queries(spark, sf), 3), "doc_id")
        th = routing.verify_thresholds(F.lit(it))
        return routing.verify_answers(tier.select("query_id", F.col("text").alias("answer")), top, "query_id", thresholds=th)

    return find, rerank, confidences, verify, docs.select("doc_id", F.col("source").alias("topic"))


def loop(spark, sf, rounds=fixed.MAX_ITERATIONS):
    return routing.action_loop(d.queries(spark, sf), *loop_parts(spark, sf), rounds=rounds)


relation("lrank", f"""
    SELECT query_id, doc_id, score, rank FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END, 6) AS score
            FROM (SELECT h.query_id, h.doc_id, {sql_alnum('q.text')} AS a, {sql_alnum('corpus.text')} AS b FROM bm25 h JOIN q USING (query_id) JOIN corpus USING (doc_id) WHERE h.rank <= 20)))
    WHERE rank <= 10""", ("bm25", "q", "corpus"))


@query("action_loop_round1", """
    SELECT query_id, round(0.3 * max(score), 6) AS confidence, CASE WHEN round(0.3 * max(score), 6) >= 0.20 THEN 'answer' WHEN round(0.3 * max(score), 6) < 0.10 THEN 'ticket' ELSE 'best_effort' END AS action, 1 AS iterations
    FROM lrank GROUP BY query_id""", ("lrank",))
def action_loop_round1(spark, sf):
    done = loop(spark, sf, rounds=1)[0]
    action = F.when(F.col("action") == "answer_verify", "best_effort").otherwise(F.col("action"))
    return done.select("query_id", "confidence", action.alias("action"), "iterations")


@query("action_loop")
def action_loop(spark, sf):
    """Both rounds (verification and query refinement make the second round's SQL twin impractical)."""
    return loop(spark, sf)[0]


def fused_stages(spark, sf):
    """``stages(adaptive)`` of the variants over the test tables: fused search, lexical reranking, tool choice and verification.

    A part of a question keeps the question's vector; a refined text changes its words only.
    """
    docs, path = d.corpus(spark, sf), scratch_dir(spark, "index")
    index.save_index(d.lexical(spark, sf), path)
    ix = index.load_index(spark, path, "doc_id")
    dense = staged(d.dense_top(spark, sf, 40), "dense").withColumnRenamed("query_id", "_p")
    topics = docs.select("doc_id", F.col("source").alias("topic"))
    parent = F.substring_index(F.col("query_id").cast("string"), "/", 1).cast("bigint")
    weight = d.queries(spark, sf).select(F.col("query_id").alias("_p"), retrieve.resolve_alpha(predicted=1.3 - features.features4("text", F.lit(0.0))["keyword_density"]).alias("alpha"))

    def stages(adaptive):
        def find(qs):
            own = qs.select("query_id", parent.alias("_p"))
            near = dense.join(broadcast_if(own), "_p").select("query_id", "doc_id", "score", "rank")
            cand = retrieve.candidates(near, retrieve.bm25_topk(qs, ix, 40))
            if adaptive:
                cand = cand.join(own.join(weight, "_p").select("query_id", "alpha"), "query_id")
            return retrieve.fused(cand, F.col("alpha") if adaptive else fixed.ALPHA_DEFAULT, 20).select("query_id", "doc_id", "score", "rank")

        def rerank(found, qs):
            return retrieve.rerank_topk(retrieve.with_texts(found.select("query_id", "doc_id"), docs, qs, 20), 10).select("query_id", "doc_id", "score", "rank")

        def score(ranked):
            # a result that mostly comes from one section asks for the policy, a mixed one for another search
            named = ranked.join(topics, "doc_id", "left").groupBy("query_id", "topic").agg(F.count("*").alias("n"), F.max("score").alias("s"))
            best = named.groupBy("query_id").agg(F.round(0.3 * F.max("s"), 6).alias("confidence"), (F.max("n") / F.sum("n")).alias("m"))
            return best.select("query_id", "confidence", F.array(F.lit(0.0), 1 - F.col("m"), F.col("m"), F.lit(0.0)).alias("tool_probs"))

        def verify(tier, ranked, it):
            top = staged(ranked.filter("rank <= 3").select("query_id", "doc_id", "rank"), "top")
            texts = docs.select("doc_id", F.col("text").alias("cited_text")).join(broadcast_if(top), "doc_id")
            return routing.verify_answers(tier.select("query_id", F.col("text").alias("answer")), texts, "query_id", thresholds=routing.verify_thresholds(F.lit(it)))

        return find, rerank, score, verify, topics

    policies = topics.filter("topic IS NOT NULL").groupBy(F.col("topic").alias("section_id")).agg(F.min("doc_id").alias("pos"))
    told = lambda c: F.array_join(F.slice(tx.sentences(F.get(c, F.lit(0))["cited_text"]), 1, 3), " ")
    finish = lambda outcome, asked: responses.full(outcome, asked, docs, topics, policies, told)
    return stages, finish


# The first pass of the loop over fused candidates, without a second round: what is not an answer or a ticket is answered as well as it can be.
@query("loop_responses_round1", """
    SELECT query_id, CASE WHEN confidence >= 0.20 THEN 'answer' WHEN confidence >= 0.15 THEN 'answer_verify' WHEN confidence >= 0.10 THEN 'best_effort' ELSE 'ticket' END AS action, confidence,
           CASE WHEN confidence < 0.10 THEN 'TKT-' || upper(substr(sha256(query_id::VARCHAR), 1, 10)) END AS ticket_id, ids AS retrieved, ids[1:5] AS grounding,
           list_filter(ids[1:5], lambda d, i: best <= 0 OR scores[i] >= best * 0.6 OR i <= 2) AS cited,
           CASE WHEN confidence >= 0.20 THEN ['AnswerDirect'] WHEN confidence >= 0.15 THEN ['AnswerDirect', 'AnswerVerify']
                WHEN confidence >= 0.10 THEN [CASE WHEN 2 * most > n THEN 'GetPolicy' ELSE 'SearchKB' END, 'AnswerDirect'] ELSE ['CreateTicket'] END AS tools
    FROM (SELECT query_id, round(0.3 * max(score), 6) AS confidence, max(score) AS best, list(doc_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores, count(*) AS n FROM rerank GROUP BY 1)
    JOIN (SELECT query_id, max(m) AS most FROM (SELECT query_id, source, count(*) AS m FROM rerank JOIN corpus USING (doc_id) GROUP BY 1, 2) GROUP BY 1) USING (query_id)""", ("rerank", "corpus"))
def loop_responses_round1(spark, sf):
    stages, finish = fused_stages(spark, sf)
    q = d.queries(spark, sf)
    rows = finish(routing.action_loop(q, *stages(False), rounds=1), q)
    ids = lambda c: F.transform(c, lambda x: x["doc_id"])
    return rows.select("query_id", "action", "confidence", "ticket_id", "retrieved", ids("grounding_citations").alias("grounding"), ids("citations").alias("cited"),
                       F.transform("tool_calls", lambda c: c["tool"]).alias("tools"))


@query("loop_responses")
def loop_responses(spark, sf):
    """Both rounds as full responses: fused search, middle-tier tools, verification, citations in two widths, calls."""
    stages, finish = fused_stages(spark, sf)
    q = d.queries(spark, sf)
    return finish(routing.action_loop(q, *stages(False)), q)


@query("variant_runs")
def variant_runs(spark, sf):
    """Every variant's responses, with loop, verification, fitted weight and decomposition run as its switches say."""
    stages, finish = fused_stages(spark, sf)
    rows = variants.run_stages(d.queries(spark, sf), stages, finish)
    return rows.select("tag", F.col("parent").alias("query_id"), "n_parts", "answer", "confidence", "iterations", "ticket_id", "verify_verdict", F.size("citations").alias("n_citations"), "tools")


@query("win_prev_confidence", """
    SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS confidence_before, value AS confidence_after FROM events""")
def win_prev_confidence(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return routing.previous_confidence(e, "user_id", "event_id", "value")
