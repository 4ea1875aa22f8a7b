"""Baselines, negatives, labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.operators import decompose, features, labels, prompts, retrieve, tools
from askloom.plans import domain as d
from askloom.plans.domain import sql_list, sql_strip, sql_words
from askloom.plans.registry import query, relation
from askloom.sources.records import short_hash
from askloom.sources.tables import table

FLAT = "query_id", "doc_id", "score", "rank"


@query("novel_candidates", "SELECT query_id, doc_id, score, rank FROM hybrid WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM bm25 WHERE rank <= 5)", ("hybrid", "bm25"))
def novel_candidates(spark, sf):
    return retrieve.drop_seen(d.hybrid_top(spark, sf), d.bm25_top(spark, sf, 5)).select(*FLAT)


@query("build_citations", """
    SELECT query_id, doc_id, rank, filtered FROM (
      SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM rerank WHERE rank <= 5), (SELECT unnest([true, false]) AS filtered)
    WHERE NOT filtered OR best <= 0 OR score >= 0.6 * best OR rank <= 2""", ("rerank",))
def build_citations(spark, sf):
    r = d.reranked(spark, sf)
    both = [retrieve.build_citations(r, filtered=f).select("query_id", "doc_id", "rank", F.lit(f).alias("filtered")) for f in (True, False)]
    return both[0].unionByName(both[1])


@query("search_kb", "SELECT query_id, doc_id, score, rank, 0 AS span_start, length(c.text) AS span_end, md5(c.text) AS text_md5, c.source FROM rerank JOIN corpus c USING (doc_id) WHERE rank <= 5", ("rerank", "corpus"))
def search_kb(spark, sf):
    hits = tools.search_kb(d.queries(spark, sf), d.lexical(spark, sf), d.query_vectors(spark, sf), d.vectors(spark, sf), d.corpus(spark, sf), 5)
    return hits.select(*FLAT, "span_start", "span_end", F.md5("text").alias("text_md5"), "source")


# Policies are parts (key: name and brand); requests are brand or name fragments met in the data.
relation("policy", "SELECT p_name || ' ' || p_brand AS section_id, min(p_partkey) AS pos FROM part GROUP BY 1")
relation("wanted", """
    SELECT p_partkey AS request, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN upper(p_name) ELSE p_name || ' ' || p_type END AS section_id FROM part""")


@query("policy_lookup", """
    SELECT request, w.section_id, coalesce(e.section_id, arg_min(f.section_id, f.pos)) AS found_id, e.section_id IS NULL AND count(f.pos) > 0 AS fuzzy
    FROM wanted w LEFT JOIN policy e ON e.section_id = w.section_id LEFT JOIN policy f ON e.section_id IS NULL AND contains(lower(f.section_id), lower(w.section_id))
    GROUP BY request, w.section_id, e.section_id""", ("policy", "wanted"))
def policy_lookup(spark, sf):
    p = table(spark, sf, "part")
    full, k = F.concat_ws(" ", "p_name", "p_brand"), F.col("p_partkey") % 3
    pol = p.groupBy(full.alias("section_id")).agg(F.min("p_partkey").alias("pos"))
    req = p.select(F.col("p_partkey").alias("request"), F.when(k == 0, full).when(k == 1, F.upper("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("section_id"))
    return tools.policy_lookup(req, pol).select("request", "section_id", "found_id", "fuzzy")


relation("hardneg", """
    SELECT query_id, doc_id, rank AS bm25_rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM bm25
    WHERE rank <= 50 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM gold)""", ("bm25", "gold"))


@query("hard_negatives", "SELECT query_id, doc_id, rank FROM hardneg WHERE bm25_rank <= 17 AND rank <= 7", ("hardneg",))
def hard_negatives(spark, sf):
    return labels.hard_negatives(d.bm25_top(spark, sf, 17), d.gold(spark, sf), 7).select("query_id", "doc_id", "rank")


_HASH = "floor(('0x' || substr(md5({key} || '|42'), 1, 8))::BIGINT / 4294967296.0 * {n})::BIGINT"


@query("random_negatives", f"""
    WITH neg_pool AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM gold)),
      neg_q AS (SELECT item_id AS query_id, (SELECT count(*) FROM gold g WHERE g.query_id = item_id) AS g FROM benchmark),
      neg_draws AS (SELECT query_id, j, ({_HASH.format(key='query_id', n='m.n')} + j - 1) % m.n + 1 AS place
                FROM (SELECT query_id, g, m.n, unnest(range(1, least(2 + g, m.n) + 1)) AS j FROM neg_q, (SELECT max(n) AS n FROM neg_pool) m) d, (SELECT max(n) AS n FROM neg_pool) m)
    SELECT query_id, doc_id, rank FROM (
      SELECT query_id, p.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY j) AS rank FROM neg_draws JOIN neg_pool p USING (place)
      WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = neg_draws.query_id AND g.doc_id = p.doc_id)) WHERE rank <= 2""", ("gold",))
def random_negatives(spark, sf):
    return labels.random_negatives(d.queries(spark, sf).select("query_id"), d.gold(spark, sf))


@query("training_pairs", """
    SELECT query_id, doc_id, 0.9 AS label FROM gold UNION ALL
    SELECT query_id, doc_id, 0.1 FROM hardneg WHERE rank <= 5 AND query_id IN (SELECT query_id FROM gold)""", ("gold", "hardneg"))
def training_pairs(spark, sf):
    gold = d.gold(spark, sf)
    hard = labels.hard_negatives(d.bm25_top(spark, sf, 50), gold, 5).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return labels.training_pairs(gold, hard, smoothing=0.1)


@query("positive_passage", rf"""
    SELECT qa_id, coalesce(CASE WHEN v < 3 AND length({sql_strip('chunk')}) > 10 THEN {sql_strip('chunk')} END, CASE WHEN v < 5 THEN query END, answer) AS passage FROM qa""", ("qa",))
def positive_passage(spark, sf):
    v = F.col("v")
    cites = F.array(F.struct(F.lit("short").alias("cited_text")), F.struct(F.when(v < 3, F.col("chunk")).alias("cited_text")))
    return d.qa(spark, sf).select("qa_id", labels.positive_passage(cites, F.when(v < 5, F.array("query")).otherwise(F.array().cast("array<string>")), F.col("answer")).alias("passage"))


@query("gold_tool_join", """
    SELECT doc_id AS query_id, CASE WHEN l.doc_id IS NULL THEN 'SearchKB' WHEN toxic = 1 THEN 'Nope' WHEN quality = 1 THEN 'AnswerDirect' ELSE 'GetPolicy' END AS gold_tool,
           CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 ELSE 2 END AS tool_index FROM documents LEFT JOIN labels l USING (doc_id)""")
def gold_tool_join(spark, sf):
    tool = F.when(F.col("toxic") == 1, "Nope").when(F.col("quality") == 1, "AnswerDirect").otherwise("GetPolicy")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), tool.alias("gold_tool"))
    return labels.gold_tools(d.corpus(spark, sf).select(F.col("doc_id").alias("query_id")), lab)


@query("resume_skip", """
    SELECT doc_id, substr(sha256(text), 1, 16) AS query_hash FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def resume_skip(spark, sf):
    docs = d.corpus(spark, sf).select("doc_id", short_hash("text").alias("query_hash"))
    return labels.resume(docs, docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")).select("doc_id", "query_hash")


@query("alpha_resolve", """
    SELECT event_id, CASE WHEN value < 10 THEN least(greatest(value / 10, 0.4), 0.9) WHEN value < 20 THEN least(greatest((value - 10) / 10, 0.4), 0.9) ELSE 0.6 END AS alpha FROM events""")
def alpha_resolve(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", retrieve.resolve_alpha(F.when(v < 10, v / 10), F.when(v < 20, (v - 10) / 10)).alias("alpha"))


relation("grid", """
    SELECT query_id, a / 10 AS alpha, count(g.doc_id) / any_value(n_gold) AS recall FROM (
      SELECT query_id, doc_id, a, row_number() OVER (PARTITION BY query_id, a ORDER BY round(a / 10 * dense_norm + (1 - a / 10) * sparse_norm, 6) DESC, doc_id) AS rank
      FROM cand, (SELECT unnest(range(0, 11)) AS a)) r
    JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) USING (query_id)
    LEFT JOIN gold g USING (query_id, doc_id) WHERE rank <= 20 GROUP BY query_id, a""", ("cand", "gold"))
_GRID = "map_from_entries(list((printf('%.2f', alpha), round(recall, 6)) ORDER BY alpha)) AS grid_scores"


@query("alpha_oracle", f"SELECT query_id, arg_max(alpha, (recall, -alpha)) AS optimal_alpha, {_GRID} FROM grid GROUP BY query_id", ("grid",))
def alpha_oracle(spark, sf):
    return labels.alpha_oracle(d.hybrid_candidates(spark, sf), d.gold(spark, sf))


@query("alpha_oracle_balanced", f"""
    SELECT query_id, CASE WHEN min(recall) = max(recall) THEN 0.5 ELSE round(median(alpha) FILTER (WHERE recall = best), 6) END AS optimal_alpha, {_GRID}
    FROM (SELECT *, max(recall) OVER (PARTITION BY query_id) AS best FROM grid) GROUP BY query_id""", ("grid",))
def alpha_oracle_balanced(spark, sf):
    return labels.alpha_oracle(d.hybrid_candidates(spark, sf), d.gold(spark, sf), balanced=True)


def _ratio(test: str, tokens: str = "low") -> str:
    return f"len(list_filter({tokens}, lambda x: {test})) / n"


def _isin(values) -> str:
    return f"list_contains({sql_list(values)}, x)"


relation("feat", rf"""
    SELECT conv_id, turn, {", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in zip(features.NAMES12, (
        "ln(1 + n)", "len(list_distinct(low)) / n", "(('0x' || substr(sha256(role), 1, 8))::BIGINT % 32) / 32", "coalesce(norm, 0)",
        "regexp_matches(text, '\"[^\"]+\"')::INT", f"list_contains({sql_list(fixed.WH_WORDS)}, low[1])::INT", _ratio(r"regexp_matches(x, '^\d[\d,.$%]*$')"),
        "list_sum(list_transform(tokens, lambda x: length(x))) / n / 10", _ratio(_isin(fixed.FEATURE_STOPWORDS)), _ratio(r"regexp_matches(x, '^\p{Lu}')", "tokens"),
        f"(len(list_filter(low, lambda x: {_isin(fixed.DEFINITION_CUES)})) > 0)::INT", _ratio(_isin(fixed.COMMON_VERBS)))))}
    FROM (SELECT *, list_transform(tokens, lambda x: regexp_replace(lower(x), '[?.,!;:]+$', '')) AS low, greatest(len(tokens), 1) AS n
          FROM (SELECT conv_id, turn, role, text, {sql_words('text')} AS tokens, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm
                FROM conversations LEFT JOIN embeddings ON vec_id = conv_id))""")


def conversation_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return table(spark, sf, "conversations").join(e, "conv_id", "left").withColumn("norm", F.coalesce(maths.norm("embedding"), F.lit(0.0)))


@query("query_features12", "SELECT * FROM feat", ("feat",))
def query_features12(spark, sf):
    f = features.features12("text", "role", F.col("norm"))
    return conversation_vectors(spark, sf).select("conv_id", "turn", *[F.round(c, 6).alias(n) for n, c in f.items()])


@query("query_features4", "SELECT conv_id, turn, round(ln(1 + len(w)), 6) AS length, round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS keyword_density, query_emb_norm AS embedding_norm, has_exact_phrase FROM feat JOIN (SELECT conv_id, turn, "
       + sql_words("lower(text)") + " AS w FROM conversations) USING (conv_id, turn)", ("feat",))
def query_features4(spark, sf):
    f = features.features4("text", F.col("norm"))
    return conversation_vectors(spark, sf).select("conv_id", "turn", *[F.round(c, 6).alias(n) for n, c in f.items()])


@query("mean_pool_evidence", """
    SELECT query_id, list(round(m, 6) ORDER BY i) AS evidence FROM (
      SELECT query_id, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT query_id, doc_id FROM dense WHERE rank <= 5) JOIN embeddings ON vec_id = doc_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
    GROUP BY query_id""", ("dense",))
def mean_pool_evidence(spark, sf):
    return labels.mean_pool(d.dense_top(spark, sf, 5), d.vectors(spark, sf), d.query_vectors(spark, sf).select("query_id"), 64)


@query("retrieve_b1", "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 5", ("bm25",))
def retrieve_b1(spark, sf):
    return retrieve.build_citations(d.bm25_top(spark, sf, fixed.TOP_K), filtered=False).select(*FLAT)


@query("retrieve_b2", "SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 5", ("dense",))
def retrieve_b2(spark, sf):
    return retrieve.build_citations(d.dense_top(spark, sf, fixed.TOP_K), filtered=False).select(*FLAT)


relation("b3", """
    SELECT query_id, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM rerank5 WHERE rank <= 5)
    WHERE best <= 0 OR score >= 0.6 * best OR rank <= 2""", ("rerank5",))


@query("retrieve_b3", "SELECT * FROM b3", ("b3",))
def retrieve_b3(spark, sf):
    return retrieve.build_citations(d.reranked(spark, sf, alpha=0.5)).select(*FLAT)


# m5 predicts its fusion weight from the query: 0.3 + keyword density, clipped.
relation("adaptive", rf"""
    SELECT query_id, doc_id, rank FROM (
      SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(alpha * dense_norm + (1.0 - alpha) * sparse_norm, 6) DESC, doc_id) AS rank
      FROM cand JOIN (SELECT query_id, least(greatest(1.3 - len(list_distinct(w)) / greatest(len(w), 1), 0.4), 0.9) AS alpha FROM (SELECT query_id, {sql_words('lower(text)')} AS w FROM q)) USING (query_id))
    WHERE rank <= 20""", ("cand", "q"))


@query("variant_matrix", """
    SELECT tag, query_id, doc_id, rank, tag IN ('m3', 'm4', 'm5') AS action_loop, tag IN ('m4', 'm5') AS verify, false AS adaptive_alpha FROM hybrid, (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS tag) WHERE rank <= 10
    UNION ALL SELECT 'm5', query_id, doc_id, rank, true, true, true FROM adaptive WHERE rank <= 10""", ("hybrid", "adaptive"))
def variant_matrix(spark, sf):
    from askloom.operators.variants import run_variants
    cand = d.hybrid_candidates(spark, sf)
    dens = features.features4("text", F.lit(0.0))["keyword_density"]
    alpha = d.queries(spark, sf).select("query_id", retrieve.resolve_alpha(predicted=1.3 - dens).alias("alpha"))
    return run_variants(cand, alpha, d.queries(spark, sf), 10).select("tag", "query_id", "doc_id", "rank", "action_loop", "verify", "adaptive_alpha")


@query("decomp_labels", rf"""
    WITH m AS (SELECT *, marks >= 2 OR regexp_matches(text, '(?i){fixed.CONJUNCTION}') AS multi, row_number() OVER (PARTITION BY marks >= 2 OR regexp_matches(text, '(?i){fixed.CONJUNCTION}') ORDER BY md5(key || '|42'), key) AS rn
                FROM (SELECT conv_id || '-' || turn AS key, text, marks FROM parts)),
      n AS (SELECT least(count_if(multi), 200) AS nm, least(count_if(NOT multi), 200) AS ns FROM m),
      rest AS (SELECT *, row_number() OVER (ORDER BY md5(key || '|42'), key) AS rr FROM m WHERE rn > 200)
    SELECT key, multi AS is_multi_part FROM m WHERE rn <= 200
    UNION ALL SELECT key, true FROM rest, n WHERE rr <= 200 - nm UNION ALL SELECT key, false FROM rest, n WHERE rr <= 200 - ns""", ("parts",))
def decomp_labels(spark, sf):
    from askloom.plans.q_text import asked
    q = asked(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return decompose.decomposition_labels(q, "key", "text", 200).select("key", "is_multi_part")


relation("prefs", rf"""
    SELECT qa_id, v, query, answer, bare, h, CASE WHEN regexp_matches(answer, '(?s)[.!?](\s|$)') THEN regexp_extract(answer, '(?s)^(.*?[.!?])(?:\s|$)', 1) ELSE left(answer, greatest(1, length(answer) // 3)) END AS cut
    FROM (SELECT qa_id, v, query, answer, {sql_strip(r"regexp_replace(answer, '\[[A-Za-z0-9_\-]+:\d+\-\d+\]', '', 'g')")} AS bare, ('0x' || substr(md5(qa_id || '|42'), 1, 8))::BIGINT / 4294967296.0 AS h
          FROM (SELECT c.qa_id, v, query, c.answer FROM cited c JOIN qa USING (qa_id)))""", ("cited", "qa"))
relation("rejected", f"""
    SELECT * FROM (
      SELECT qa_id, query, answer AS chosen, 'no_citation' AS rejection_type, {sql_strip("bare || '" + labels.GENERAL_KNOWLEDGE + "'")} AS rejected FROM prefs
      UNION ALL SELECT qa_id, query, answer, 'partial_truncation', {sql_strip('cut')} FROM prefs
      UNION ALL SELECT qa_id, query, answer, 'verbose_unfaithful', {sql_strip("bare || " + sql_list(labels.FILLERS) + f"[floor(h * {len(labels.FILLERS)})::INT + 1]")} FROM prefs
      UNION ALL SELECT qa_id, query, answer, 'wrong_tool', {sql_list(labels.WRONG_TOOL)}[floor(h * {len(labels.WRONG_TOOL)})::INT + 1] FROM prefs
      UNION ALL SELECT qa_id, query, answer, 'unsafe_tone', {sql_strip(sql_list(labels.TONE) + f"[floor(h * {len(labels.TONE)})::INT + 1] || lower(left(bare, 1)) || substr(bare, 2)")} FROM prefs)
    WHERE rejected <> '' AND rejected <> {sql_strip('chosen')}""", ("prefs",))


def corrupted(spark, sf):
    from askloom.plans.q_text import cited
    pairs = cited(spark, sf).join(d.qa(spark, sf).select("qa_id", "query"), "qa_id").select("qa_id", "query", F.col("answer").alias("chosen"))
    return labels.corrupt(pairs, d.corpus(spark, sf).select("doc_id"), "qa_id", "chosen")


@query("corrupt_answers", "SELECT qa_id, rejection_type, rejected FROM rejected", ("rejected",))
def corrupt_answers(spark, sf):
    return corrupted(spark, sf).filter("rejection_type <> 'hallucinated_citation'").select("qa_id", "rejection_type", "rejected")


@query("corrupt_citation", f"""
    WITH one AS (SELECT b, min(doc_id::VARCHAR) AS fake FROM (SELECT doc_id, {_HASH.format(key='doc_id', n='greatest(1, n // 4)')} AS b FROM documents, (SELECT count(*) AS n FROM documents)) GROUP BY b),
      p AS (SELECT qa_id, answer, regexp_extract(answer, '\\[[A-Za-z0-9_\\-]+:\\d+\\-\\d+\\]') AS mark, {_HASH.format(key='qa_id', n='greatest(1, n // 4)')} AS b FROM prefs, (SELECT count(*) AS n FROM documents))
    SELECT qa_id, 'hallucinated_citation' AS rejection_type, rejected FROM (
      SELECT qa_id, answer, replace(answer, mark, '[' || coalesce(fake, 'fa' || substr(md5(qa_id), 1, 14)) || regexp_extract(mark, '(:\\d+-\\d+\\])$', 1)) AS rejected
      FROM p LEFT JOIN one USING (b) WHERE mark <> '')
    WHERE rejected <> '' AND {sql_strip('rejected')} <> {sql_strip('answer')}""", ("prefs",))
def corrupt_citation(spark, sf):
    """The swapped-citation kind."""
    return corrupted(spark, sf).filter("rejection_type = 'hallucinated_citation'").select("qa_id", "rejection_type", "rejected")


@query("format_dpo", "SELECT qa_id, rejection_type, '<|user|>' || chr(10) || query || chr(10) || '<|assistant|>' || chr(10) AS prompt, chosen, rejected FROM rejected WHERE rejection_type IN ('no_citation', 'wrong_tool')", ("rejected",))
def format_dpo(spark, sf):
    return prompts.dpo_rows(corrupted(spark, sf), ("no_citation", "wrong_tool"))
