"""Answers from one user's own collection: dense only, with a similarity floor and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions.text import any_phrase
from askloom.operators.retrieve import dense_topk, dense_topk_within
from askloom.operators.tools import escalate


def answer_from_collection(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, members: DataFrame, answer: Column, now: Column,
                           k: int = 5, floor: float = fixed.SIMILARITY_FLOOR) -> DataFrame:
    """One row per query: an answer from its hits, or a ticket when there is no hit or the answer says so.

    ``members`` (doc_id) is the collection; ``answer`` is the answer column over (query_id, text).
    """
    mine = vectors.join(members.select("doc_id"), "doc_id", "left_semi")
    return _answered(queries, dense_topk(query_vectors, mine, k).filter(F.col("score") >= floor), answer, now)


def answer_from_collections(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, members: DataFrame, answer: Column, now: Column,
                            k: int = 5, floor: float = fixed.SIMILARITY_FLOOR) -> DataFrame:
    """The same for the collections of many users in one job.

    A query (query_id, text, collection) sees its own collection's ``members`` (collection,
    doc_id) only; collections are searched in bounded cells.
    """
    asked = query_vectors.select("query_id", "embedding").join(queries.select("query_id", "collection"), "query_id")
    held = members.select("collection", "doc_id").join(vectors.select("doc_id", "embedding"), "doc_id")
    return _answered(queries, dense_topk_within(asked, held, k, "collection").filter(F.col("score") >= floor), answer, now)


def _answered(queries: DataFrame, hits: DataFrame, answer: Column, now: Column) -> DataFrame:
    counted = queries.join(hits.groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id", "left")
    judged = counted.withColumn("answer", F.when(F.col("n_hits") > 0, answer)).withColumn(
        "ok", F.col("answer").isNotNull() & ~any_phrase(F.coalesce("answer", F.lit("")), fixed.OUT_OF_SCOPE_PHRASES))
    good = judged.filter("ok").select("query_id", F.lit("answer").alias("outcome"), "answer", "n_hits", F.lit(None).cast("string").alias("ticket_id"))
    rest = escalate(judged.filter("NOT ok"), now, "out_of_scope")
    return good.unionByName(rest.select(
        "query_id", F.lit("ticket").alias("outcome"), F.lit(None).cast("string").alias("answer"), F.lit(0).cast("bigint").alias("n_hits"), "ticket_id"))
