"""Retrieval queries: index statistics, rankings, fusion, reranking, negatives, alpha labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.operators import cells, retrieve
from askloom.plans import domain as d
from askloom.plans.registry import query

FLAT = "query_id", "doc_id", "score", "rank"


@query("bm25_stats", """
    SELECT term, df, ctf::BIGINT AS ctf, round(idf, 6) AS idf,
           round((SELECT sum(tf) / (SELECT count(*) FROM corpus) FROM post), 6) AS avgdl FROM terms""", ("terms", "post", "corpus"))
def bm25_stats(spark, sf):
    ix = d.lexical(spark, sf)
    return ix.terms.select("term", "df", "ctf", F.round("idf", 6).alias("idf"), F.round(ix.totals.select("avgdl").scalar(), 6).alias("avgdl"))


@query("bm25_topk", "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10", ("bm25",))
def bm25_topk(spark, sf):
    return d.bm25_top(spark, sf, 10).select(*FLAT)


@query("dense_topk", "SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 10", ("dense",))
def dense_topk(spark, sf):
    return d.dense_top(spark, sf, 10).select(*FLAT)


@query("dense_topk_ann")
def dense_topk_ann(spark, sf):
    """Approximate ranking beside the exact one: the result is recall per query."""
    q, v = d.query_vectors(spark, sf), d.vectors(spark, sf)
    approx = cells.search(cells.build(v, 10), q, 10).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = retrieve.dense_topk(q, v, 10).select("query_id", "doc_id")
    joined = exact.join(approx, ["query_id", "doc_id"], "left")
    return joined.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall_at_10"))


@query("minmax_norm", "SELECT query_id, doc_id, round(dense_norm, 6) AS dense_norm, round(sparse_norm, 6) AS sparse_norm FROM cand", ("cand",))
def minmax_norm(spark, sf):
    return d.hybrid_candidates(spark, sf).select(
        "query_id", "doc_id", F.round("dense_norm", 6).alias("dense_norm"), F.round("sparse_norm", 6).alias("sparse_norm"))


@query("hybrid_fuse", "SELECT query_id, doc_id, score, rank FROM hybrid", ("hybrid",))
def hybrid_fuse(spark, sf):
    return d.hybrid_top(spark, sf).select(*FLAT)


@query("rerank_topk", "SELECT query_id, doc_id, score, rank FROM rerank", ("rerank",))
def rerank_topk(spark, sf):
    return d.reranked(spark, sf).select(*FLAT)
