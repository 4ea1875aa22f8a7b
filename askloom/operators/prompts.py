"""Prompts and training rows assembled from tables. Wording is a parameter; the layout is fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.sources.records import first_present

SYSTEM = "Answer only from the context. Say so when the context does not hold the answer."
# Question frames per type: own wording, six per type, made from a rule so that callers can swap them.
FRAME_ASKS = ("the main rule", "a condition", "a limit or deadline", "an exception", "a consequence", "two linked facts")


def ordered_join(order: str, line: Column, sep: str) -> Column:
    """Aggregate: lines joined in the order of a column."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return F.array_join(F.transform(rows, lambda x: x["l"]), sep)


def assemble_prompts(contexts: DataFrame, queries: DataFrame, history: DataFrame | None = None, query: str = "query_id",
                     system: str = SYSTEM) -> DataFrame:
    """(query, prompt). ``contexts``: doc_id, span_start, span_end, text, rank per query. ``history``: turns text per query."""
    line = tx.context_line("doc_id", "span_start", "span_end", "text")
    ctx = contexts.groupBy(query).agg(ordered_join("rank", line, "\n\n").alias("_ctx"))
    out = queries.join(ctx, query, "left")
    past = F.lit("")
    if history is not None:
        out = out.join(history.select(query, F.col("history").alias("_past")), query, "left")
        past = F.when(F.coalesce("_past", F.lit("")) == "", "").otherwise(F.concat("_past", F.lit("\n")))
    return out.select(query, F.concat(
        F.lit(f"<|system|>\n{system}\n<|context|>\n"), F.coalesce("_ctx", F.lit("(no context)")), F.lit("\n"), past,
        F.lit("<|user|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|assistant|>\n"),
    ).alias("prompt"))


def history_turns(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, history): user and assistant turns in order, tagged by role."""
    kept = turns.filter(F.col("role").isin("user", "assistant"))
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    return kept.groupBy(conv).agg(ordered_join("turn", line, "\n").alias("history"))


def sft_rows(records: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(prompt, response) from records with ``query``, ``citations`` and one of the answer fields."""
    lines = F.transform("citations", lambda c: tx.context_line(
        F.coalesce(c["chunk_id"], c["doc_id"], F.lit("unknown")), F.coalesce(c["span_start"], F.lit(0)),
        F.coalesce(c["span_end"], F.length(c["cited_text"])), F.coalesce(c["cited_text"], F.lit(""))))
    prompt = F.concat(
        F.lit(f"<|system|>\n{system}\n<|context|>\n"), F.coalesce(F.array_join(lines, "\n\n"), F.lit("")),
        F.lit("\n<|user|>\n"), F.col("query"), F.lit("\n<|assistant|>\n"))
    answer = F.coalesce(first_present("answer_with_citations", "answer_without_citations", "answer"), F.lit(""))
    return records.select("qa_id", prompt.alias("prompt"), tx.strip_citations(answer).alias("response"))


def dpo_rows(preferences: DataFrame, kinds=fixed.REJECTION_TYPES) -> DataFrame:
    prompt = F.concat(F.lit("<|user|>\n"), F.col("query"), F.lit("\n<|assistant|>\n"))
    return preferences.filter(F.col("rejection_type").isin(*kinds)).select(
        "qa_id", "rejection_type", prompt.alias("prompt"), "chosen", "rejected")


def confidence_prompts(contexts: DataFrame, queries: DataFrame, query: str = "query_id") -> DataFrame:
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit(":"), F.col("span_start").cast("string"), F.lit("-"),
                    F.col("span_end").cast("string"), F.lit("]\n"), F.col("text"))
    ctx = contexts.groupBy(query).agg(ordered_join("rank", line, "\n\n").alias("_ctx"))
    return queries.join(ctx, query, "left").select(query, F.concat(
        F.lit("Use only the context and cite each fact with its [chunk_id:start-end] marker.\n\nCONTEXT:\n"),
        F.coalesce("_ctx", F.lit("")), F.lit("\n\nQUESTION: "), F.col("text"), F.lit("\n\nANSWER:")).alias("prompt"))


def alternate_qtype(qtype) -> Column:
    m = F.create_map(*[F.lit(x) for kv in fixed.QTYPE_ALTERNATE.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.col(qtype) if isinstance(qtype, str) else qtype), F.lit("policy"))


def qa_prompts(chunks: DataFrame, key: str, qtype: str, seed: int = 42, retry: bool = False) -> DataFrame:
    """(key, qtype, frame, prompt): the frame rotates with a hash of the key; a retry uses the alternate type."""
    kind = alternate_qtype(qtype) if retry else F.col(qtype)
    frame = maths.hash_below(key, seed, len(FRAME_ASKS)).cast("int")
    ask = F.get(F.array(*[F.lit(a) for a in FRAME_ASKS]), frame)
    return chunks.select(key, kind.alias("qtype"), frame.alias("frame"), F.concat(
        F.lit("PASSAGE:\n"), F.col("text"), F.lit("\n\nQUESTION TYPE: "), F.upper(kind), F.lit("\nASK ABOUT: "), ask,
        F.lit('\n\nReply with strict JSON: {"query": "...", "answer": "..."}')).alias("prompt"))
