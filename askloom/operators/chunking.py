"""Documents into overlapping windows of words with exact character spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.sources.records import chunk_id_of
from askloom.util import balanced


def chunk_windows(
    blocks: DataFrame,
    keys: list[str],
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    minimum: int = fixed.CHUNK_MIN,
    text: str = "text",
) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap`` words; those under ``minimum`` are dropped.

    Runs without a shuffle. Words keep their trailing white space, so a window joined
    back is the exact substring, and spans come from block lengths, not from a search:
    the text is cut once into step-sized blocks whose lengths are summed.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than the window size")
    step = size - overlap
    pieces = balanced(blocks).select(
        *keys,
        F.regexp_extract_all(text, F.lit(r"\S+\s*"), 0).alias("_w"),
        F.length(F.regexp_extract(text, r"^\s*", 0)).alias("_lead"),
    )
    n = F.size("_w")
    lengths = pieces.withColumn(
        "_len",
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / step).cast("int"), F.lit(0))),
            lambda i: F.length(F.array_join(F.slice(F.col("_w"), i * step + 1, step), "")),
        ),
    )
    n_windows = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    # Short blocks get no windows here rather than in a filter, which would split the text twice.
    indexes = F.when(n >= minimum, F.sequence(F.lit(0), n_windows - 1))
    windows = lengths.select(*keys, "_w", "_lead", "_len", F.explode_outer(indexes).alias("_i")).filter("_i IS NOT NULL")
    body = windows.select(
        *keys,
        F.col("_i").alias("chunk_index"),
        F.slice("_w", F.col("_i") * step + 1, F.lit(size)).alias("_p"),
        (F.col("_lead") + F.aggregate(F.slice("_len", F.lit(1), F.col("_i")), F.lit(0), lambda s, x: s + x)).alias("span_start"),
    )
    if overlap < minimum:  # otherwise even the last window is long enough
        body = body.filter(F.size("_p") >= minimum)
    return (
        body.withColumn("text", F.regexp_replace(F.array_join("_p", ""), r"\s+$", ""))
        .select(
            *keys, "chunk_index", "text", F.size("_p").alias("token_count"), "span_start",
            (F.col("span_start") + F.length("text")).alias("span_end"),
        )
    )


def number_chunks(windows: DataFrame, doc: str, block: str) -> DataFrame:
    """Let ``chunk_index`` run on across the blocks (pages) of a document, and add chunk ids.

    Offsets are summed per block first, so the ordered step sees one row per block and not
    one per chunk.
    """
    per_block = windows.groupBy(doc, block).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(doc).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(doc, block, F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("int").alias("_off"))
    out = windows.join(offsets, [doc, block]).withColumn("chunk_index", F.col("chunk_index") + F.col("_off")).drop("_off")
    return out.withColumn("chunk_id", chunk_id_of(F.col(doc).cast("string"), "chunk_index"))


# Breaks from strongest to weakest: paragraph, sentence, line, space.
BREAKS = (r"\n{2,}", r"[.!?]\s+", r"\n", r"\s+")


def refine_boundaries(spans: DataFrame, text: str = "text", start: str = "span_start", end: str = "span_end",
                      reach: int = 64) -> DataFrame:
    """Move both ends of word-aligned spans at most ``reach`` characters to the strongest break there.

    The start goes behind the first break after it, the end behind the last break before it.
    Off by default in ingestion. Stays in the JVM: each end is one anchored pattern per kind
    of break over a window of ``reach`` characters.
    """
    t, s, e = F.col(text), F.col(start), F.least(F.col(end), F.length(text))
    head = F.substring(t, s + 1, F.lit(reach))
    moved = F.coalesce(*[
        F.when((hop > 0) & (s + hop < e), s + hop)
        for hop in (F.length(F.regexp_extract(head, r"(?s)^.*?" + rx, 0)) for rx in BREAKS)
    ], s)
    out = spans.withColumn("refined_start", moved)
    begin = F.greatest(e - reach, F.col("refined_start") + 1)
    tail = F.substring(t, begin, e - begin + 1)  # one character before the search range: patterns need one
    hops = [
        F.length(F.regexp_extract(tail, r"(?s)^.*[.!?]\s+" if rx == BREAKS[1] else r"(?s)^.+" + rx, 0)) for rx in BREAKS
    ]
    out = out.withColumn("refined_end", F.coalesce(*[F.when(h > 0, begin - 1 + h) for h in hops], e))
    body = F.substring(t, F.col("refined_start") + 1, F.col("refined_end") - F.col("refined_start"))
    return out.withColumn("refined_text", F.regexp_replace(body, r"^\s+|\s+$", ""))
