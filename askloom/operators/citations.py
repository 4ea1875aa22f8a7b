"""Citation markers of answers resolved against their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import text as tx


def parse_citations(answers: DataFrame, contexts: DataFrame, key: str, answer: str = "answer", kind: str = "any_id") -> DataFrame:
    """Distinct (doc_id, span) markers per answer with the text they point at.

    The last context row of a document (by rank) counts. Offsets are relative to that
    row's span; an empty cut gives the whole text, an unknown document an empty text.
    """
    marks = (
        answers.select(key, F.posexplode_outer(tx.citation_markers(answer, kind)).alias("pos", "m"))
        .filter("m IS NOT NULL")
        .groupBy(key, "m.doc_id", "m.span_start", "m.span_end")
        .agg((F.min("pos") + 1).alias("pos"))
    )
    last = contexts.groupBy(key, "doc_id").agg(F.max_by(F.struct("text", F.col("span_start").alias("at")), "rank").alias("c"))
    begin = F.greatest(F.lit(0), F.col("span_start") - F.col("c.at"))
    end = F.greatest(begin, F.col("span_end") - F.col("c.at"))
    cut = F.substring(F.col("c.text"), begin + 1, end - begin)
    text = F.when(F.col("c").isNull(), "").when(cut == "", F.col("c.text")).otherwise(cut)
    return marks.join(last, [key, "doc_id"], "left").select(key, "doc_id", "span_start", "span_end", "pos", text.alias("cited_text"))


def unresolved(answers: DataFrame, docs: DataFrame, key: str, answer: str = "answer", kind: str = "any_id") -> DataFrame:
    """Markers naming a document that does not exist."""
    marks = answers.select(key, F.explode_outer(tx.citation_markers(answer, kind)).alias("m")).filter("m IS NOT NULL")
    return marks.select(key, "m.doc_id", "m.span_start", "m.span_end").join(docs.select("doc_id"), "doc_id", "left_anti")


def citation_struct(doc: Column, chunk: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(doc.alias("doc_id"), chunk.alias("chunk_id"), start.alias("span_start"), end.alias("span_end"), text.alias("cited_text"))
