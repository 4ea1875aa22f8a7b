"""The engine's relations over the test tables, once as DataFrames and once as oracle SQL.

corpus = documents, queries = benchmark, vectors = embeddings (vec_id is the document's
id and also the query's), question/answer pairs = a user turn and the assistant turn after
it, audit log = events. Question/answer pairs are decorated by a fixed rule so that every
cleaning rule has rows on both of its sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions import text as tx
from askloom.operators import chunking, index, retrieve
from askloom.plans.registry import relation
from askloom.sources.tables import table
from askloom.util import broadcast_if, staged


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_any(col: str, phrases) -> str:
    """Oracle twin of ``any_phrase``."""
    return f"list_bool_or(list_transform({sql_list(phrases)}, lambda p: contains(lower({col}), p)))"


def sql_count(col: str, phrases) -> str:
    return f"len(list_filter({sql_list(phrases)}, lambda p: contains(lower({col}), p)))"


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def sql_words(e: str) -> str:
    return rf"list_filter(string_split_regex({e}, '\s+'), lambda w: w <> '')"


def sql_bm25_tokens(e: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda w: w <> '')"


def sql_alnum(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[a-z0-9]+')"


def sql_wordchars(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+')"


def sql_sentences(e: str) -> str:
    return rf"list_filter(string_split(regexp_replace({sql_strip(e)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def sql_content(e: str, stop=fixed.CANONICAL_STOPWORDS) -> str:
    return f"list_filter({sql_wordchars(e)}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(stop)}, w))"


# ---- DataFrames ----------------------------------------------------------------

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    ids = queries(spark, sf).select("query_id")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return v.join(ids, "query_id", "left_semi")


def lexical(spark: SparkSession, sf: str) -> index.LexicalIndex:
    return index.build_index(corpus(spark, sf), "doc_id")


def bm25_top(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return retrieve.bm25_topk(queries(spark, sf), lexical(spark, sf), k)


def dense_top(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return retrieve.dense_topk(query_vectors(spark, sf), vectors(spark, sf), k)


def hybrid_candidates(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return retrieve.candidates(dense_top(spark, sf, 2 * k), bm25_top(spark, sf, 2 * k))


def hybrid_top(spark: SparkSession, sf: str, k: int = 20, alpha: float = fixed.ALPHA_DEFAULT) -> DataFrame:
    return retrieve.fused(hybrid_candidates(spark, sf, k), alpha, k)


def reranked(spark: SparkSession, sf: str, alpha: float = fixed.ALPHA_DEFAULT, k: int = 20, keep: int = 10) -> DataFrame:
    q = queries(spark, sf)
    found = hybrid_top(spark, sf, k, alpha).select("query_id", "doc_id")
    return retrieve.rerank_topk(retrieve.with_texts(found, corpus(spark, sf), q, k), keep)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.containing_docs(corpus(spark, sf), queries(spark, sf))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf).select("doc_id", "source", "text")
    return chunking.chunk_windows(docs, ["doc_id", "source"])


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, question, answer): an equi-join on (conversation, turn), so long conversations spread out."""
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


OPENINGS = ("When can ", "What ", "Why ", "Under what condition ", "", "In what table ", "When must ")
ENDINGS = (
    " You must file it if 3 days pass.", " [ab12cd34:0-20] It applies only when due.", " This ensures that all is well.",
    " The text does not specify it.", " And so on...", " So 1 + 2 makes 12345678901.", " They do it to comply with rules unless exempt.",
)
KINDS = ("procedural", "policy", "eligibility", "factoid", "multi_hop", "comparison", "procedural")


def qa(spark: SparkSession, sf: str) -> DataFrame:
    """Decorated pairs: qa_id, query, answer, chunk (context text), qtype, gold_doc, v."""
    t = turns(spark, sf).withColumn("v", ((F.col("conv_id") * 3 + F.col("turn")) % 7).cast("int"))

    def pick(values):
        return F.get(F.array(*[F.lit(x) for x in values]), F.col("v"))

    bare = F.regexp_replace(F.regexp_replace("question", r"\s+", " "), r"[.!? ]+$", "")
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("qa_id"), "conv_id", "turn", "v",
        F.concat(pick(OPENINGS), bare, F.when(F.col("v") == 4, ".").otherwise("?")).alias("query"),
        F.concat("answer", pick(ENDINGS)).alias("answer"),
        F.when(F.col("v") % 2 == 0, F.col("answer")).otherwise(F.col("question")).alias("chunk"),
        pick(KINDS).alias("qtype"),
    )


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Gold per query: the item's text as answer, the documents that contain it with the span, a needed tool, a flag."""
    pairs = staged(gold(spark, sf), "gold")  # its size is then known, and bounds what may be broadcast
    docs, q = corpus(spark, sf).select("doc_id", F.col("text").alias("hay")), queries(spark, sf)
    at = docs.join(broadcast_if(pairs), "doc_id").join(broadcast_if(q), "query_id")
    start = (F.instr("hay", F.col("text")) - 1).cast("int")
    cites = at.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", start.alias("span_start"), (start + F.length("text")).alias("span_end")))).alias("gold_citations"))
    none = F.array().cast("array<struct<doc_id:bigint,span_start:int,span_end:int>>")
    k = F.col("query_id")
    out = q.join(cites, "query_id", "left").select("query_id", F.col("text").alias("gold_answer"), F.coalesce("gold_citations", none).alias("gold_citations"),
        F.when(k % 3 == 1, "SearchKB").when(k % 3 == 2, "CreateTicket").alias("needed_tool"), (k % 4 == 0).alias("should_escalate"))
    return out.withColumn("gold_ids", F.transform("gold_citations", lambda c: c["doc_id"]))


TAGS = {"b1": 1, "b2": 2, "b3": 3}


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of the three baselines: answer = first three sentences of the best document, citations = up to five.

    The two candidate lists are written once and shared by the three baselines.
    """
    q = queries(spark, sf)
    sparse, dense = staged(bm25_top(spark, sf, 40), "sparse"), staged(dense_top(spark, sf, 40), "dense")
    hybrid = retrieve.fused(retrieve.candidates(dense, sparse), 0.5, 20).select("query_id", "doc_id")
    reranked5 = retrieve.rerank_topk(retrieve.with_texts(hybrid, corpus(spark, sf), q, 20), 10)
    lists = {"b1": sparse.filter("rank <= 5"), "b2": dense.filter("rank <= 5"), "b3": retrieve.build_citations(reranked5)}
    hits = None
    for tag, df in lists.items():
        part = df.select(F.lit(tag).alias("model_tag"), "query_id", "doc_id", "rank")
        hits = part if hits is None else hits.unionByName(part)
    tag = F.col("model_tag")
    text = corpus(spark, sf).select("doc_id", "text").join(broadcast_if(hits, q, 20), "doc_id")
    cite = F.struct("rank", "doc_id", F.lit(0).alias("span_start"), F.when(tag == "b3", 0).otherwise(F.length("text")).alias("span_end"), F.col("text").alias("cited_text"))
    held = text.groupBy("model_tag", "query_id").agg(F.array_sort(F.collect_list(cite)).alias("citations"))
    n = F.when(tag == "b1", 1).when(tag == "b2", 2).otherwise(3)
    k = F.col("query_id")
    return held.select(
        "model_tag", "query_id", F.array_join(F.slice(tx.sentences(F.get("citations", F.lit(0))["cited_text"]), 1, 3), " ").alias("answer"),
        F.transform("citations", lambda c: c["doc_id"]).alias("retrieved"),
        F.transform("citations", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["span_start"].alias("span_start"), c["span_end"].alias("span_end"), c["cited_text"].alias("cited_text"))).alias("citations"),
        F.when(tag == "b1", F.array(F.lit("SearchKB"))).when(tag == "b2", F.array(F.lit("SearchKB"), F.lit("WebSearch"))).otherwise(F.array(F.lit("SearchKB"), F.lit("CreateTicket"))).alias("tools"),
        F.when((tag == "b3") & (k % 5 == 0), F.concat(F.lit("T"), k.cast("string"))).alias("ticket_id"),
        (((k * 13 + n * 7) % 100) / 100).alias("confidence"), F.when(tag == "b3", k % 3).otherwise(0).cast("int").alias("iterations"),
        (k * 1.5 + n * 10).alias("latency_ms"), F.when(tag != "b2", k * 0.5 + n).alias("ttft_ms"))


relation("corpus", "SELECT doc_id, text, source, lang FROM documents")
relation("q", "SELECT item_id AS query_id, text FROM benchmark")
relation("tok", f"SELECT doc_id, {sql_bm25_tokens('text')} AS t FROM corpus", ("corpus",))
relation("post", """
    SELECT doc_id, dl, term, count(*) AS tf
    FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL""", ("tok",))
relation("raw_terms", """
    SELECT term, count(*) AS df, sum(tf) AS ctf,
           ln((SELECT count(*) FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
    FROM post GROUP BY term""", ("post",))
relation("terms", """
    SELECT term, df, ctf,
           CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw_terms) ELSE raw_idf END AS idf
    FROM raw_terms""", ("raw_terms",))
relation("qterms", f"""
    SELECT query_id, term, count(*) AS qtf
    FROM (SELECT query_id, unnest({sql_bm25_tokens('text')}) AS term FROM q) GROUP BY ALL""", ("q",))
relation("bm25_all", """
    SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5
             / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT sum(tf) / (SELECT count(*) FROM corpus) FROM post)))), 6) AS score
    FROM qterms JOIN terms USING (term) JOIN post USING (term) GROUP BY ALL""", ("qterms", "terms"))
relation("bm25", """
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM bm25_all WHERE score > 0""", ("bm25_all",))
relation("qv", "SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN (SELECT query_id FROM q)", ("q",))
relation("dense", """
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], qv), 6) AS score
          FROM embeddings, qv)""", ("qv",))
relation("cand", """
    SELECT query_id, doc_id, dense_score, sparse_score,
      CASE WHEN max(dense_score) OVER p - min(dense_score) OVER p < 1e-12
           THEN CASE WHEN max(dense_score) OVER p = 0 THEN 0.0 ELSE 1.0 END
           ELSE (dense_score - min(dense_score) OVER p) / (max(dense_score) OVER p - min(dense_score) OVER p) END AS dense_norm,
      CASE WHEN max(sparse_score) OVER p - min(sparse_score) OVER p < 1e-12
           THEN CASE WHEN max(sparse_score) OVER p = 0 THEN 0.0 ELSE 1.0 END
           ELSE (sparse_score - min(sparse_score) OVER p) / (max(sparse_score) OVER p - min(sparse_score) OVER p) END AS sparse_norm
    FROM (SELECT query_id, doc_id, coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS sparse_score
          FROM (SELECT * FROM dense WHERE rank <= 40) d
          FULL JOIN (SELECT * FROM bm25 WHERE rank <= 40) s USING (query_id, doc_id))
    WINDOW p AS (PARTITION BY query_id)""", ("dense", "bm25"))
for _name, _alpha in (("hybrid", 0.6), ("hybrid5", 0.5)):
    relation(_name, f"""
    SELECT * FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, round({_alpha} * dense_norm + (1.0 - {_alpha}) * sparse_norm, 6) AS score FROM cand))
    WHERE rank <= 20""", ("cand",))
for _name, _src in (("rerank", "hybrid"), ("rerank5", "hybrid5")):
    relation(_name, f"""
    SELECT query_id, doc_id, score, rank FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
                     ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END, 6) AS score
            FROM (SELECT h.query_id, h.doc_id, {sql_alnum('q.text')} AS a, {sql_alnum('corpus.text')} AS b
                  FROM {_src} h JOIN q USING (query_id) JOIN corpus USING (doc_id))))
    WHERE rank <= 10""", (_src, "q", "corpus"))
relation("gold", "SELECT query_id, doc_id FROM q JOIN corpus ON contains(corpus.text, q.text)", ("q", "corpus"))
relation("chunks", r"""
    SELECT doc_id, source, i::INT AS chunk_index, len(p)::INT AS token_count,
           regexp_replace(array_to_string(p, ''), '\s+$', '') AS text,
           (lead_ws + coalesce(list_sum(list_transform(w[1:i * 160], lambda x: length(x))), 0))::INT AS span_start
    FROM (SELECT doc_id, source, w, lead_ws, i, w[i * 160 + 1 : i * 160 + 256] AS p
          FROM (SELECT doc_id, source, w, lead_ws,
                       unnest(range(0, CASE WHEN len(w) <= 256 THEN 1 ELSE ceil((len(w) - 256) / 160)::BIGINT + 1 END)) AS i
                FROM (SELECT doc_id, source, regexp_extract_all(text, '\S+\s*') AS w,
                             length(regexp_extract(text, '^\s*')) AS lead_ws FROM corpus)
                WHERE len(w) >= 30))
    WHERE len(p) >= 30""", ("corpus",))
relation("turns", """
    SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'""")
relation("qa", rf"""
    SELECT conv_id || '-' || turn AS qa_id, conv_id, turn, v,
           {sql_list(OPENINGS)}[v + 1] || regexp_replace(regexp_replace(question, '\s+', ' ', 'g'), '[.!? ]+$', '')
             || CASE WHEN v = 4 THEN '.' ELSE '?' END AS query,
           answer || {sql_list(ENDINGS)}[v + 1] AS answer,
           CASE WHEN v % 2 = 0 THEN answer ELSE question END AS chunk,
           {sql_list(KINDS)}[v + 1] AS qtype
    FROM (SELECT *, ((conv_id * 3 + turn) % 7)::INT AS v FROM turns)""", ("turns",))

relation("hits", """
    SELECT 'b1' AS model_tag, query_id, doc_id, rank FROM bm25 WHERE rank <= 5
    UNION ALL SELECT 'b2', query_id, doc_id, rank FROM dense WHERE rank <= 5
    UNION ALL SELECT 'b3', query_id, doc_id, rank FROM b3""", ("bm25", "dense", "b3"))
relation("cites", """
    SELECT model_tag, query_id, doc_id, text AS cited_text, 0 AS span_start, CASE WHEN model_tag = 'b3' THEN 0 ELSE length(text) END AS span_end,
           row_number() OVER (PARTITION BY model_tag, query_id ORDER BY rank) AS pos FROM hits JOIN corpus USING (doc_id)""", ("hits", "corpus"))
relation("resp", f"""
    SELECT model_tag, query_id, n, ids, context, array_to_string(({sql_sentences('first_text')})[1:3], ' ') AS answer, ((query_id * 13 + n * 7) % 100) / 100 AS confidence,
           CASE WHEN n = 3 THEN query_id % 3 ELSE 0 END AS iterations, query_id * 1.5::DOUBLE + n * 10 AS latency_ms, CASE WHEN n <> 2 THEN query_id * 0.5::DOUBLE + n END AS ttft_ms,
           [['SearchKB'], ['SearchKB', 'WebSearch'], ['SearchKB', 'CreateTicket']][n] AS tools, CASE WHEN n = 3 AND query_id % 5 = 0 THEN 'T' || query_id END AS ticket_id
    FROM (SELECT model_tag, query_id, substr(model_tag, 2)::INT AS n, list(doc_id ORDER BY pos) AS ids, string_agg(cited_text, ' ' ORDER BY pos) AS context, arg_min(cited_text, pos) AS first_text
          FROM cites GROUP BY ALL)""", ("cites",))
relation("gold_cites", """
    SELECT query_id, doc_id, (instr(corpus.text, q.text) - 1)::INT AS span_start, (instr(corpus.text, q.text) - 1 + length(q.text))::INT AS span_end,
           row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS gi FROM gold JOIN corpus USING (doc_id) JOIN q USING (query_id)""", ("gold", "corpus", "q"))
relation("gold_rows", f"""
    SELECT q.query_id, text AS gold_answer, coalesce(gold_ids, []) AS gold_ids, CASE query_id % 3 WHEN 1 THEN 'SearchKB' WHEN 2 THEN 'CreateTicket' END AS needed_tool, query_id % 4 = 0 AS should_escalate,
           {sql_sentences("text")} AS key_points
    FROM q LEFT JOIN (SELECT query_id, list(doc_id ORDER BY gi) AS gold_ids FROM gold_cites GROUP BY 1) USING (query_id)""", ("q", "gold_cites"))
