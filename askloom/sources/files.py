"""Files in: discovery, text blocks, pluggable block parsers, upload admission."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions.text import strip
from askloom.sources.tables import BLOCK, BLOCK_FIELDS


def suffix_of(path) -> Column:
    """Lower-cased file suffix with its dot, empty when there is none."""
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def discover_files(files: DataFrame, suffixes: Sequence[str] = fixed.UPLOAD_SUFFIXES, limit: int | None = None) -> DataFrame:
    """Files with an allowed suffix in path order; ``content`` is not read."""
    out = files.select("path", "length").filter(suffix_of("path").isin(*[s.lower() for s in suffixes])).orderBy("path")
    return out if limit is None else out.limit(limit)


def text_blocks(files: DataFrame) -> DataFrame:
    """One stripped block per file; bytes that are not UTF-8 are read as ISO-8859-1; empty files drop out."""
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(
        F.decode("content", "ISO-8859-1")
    )
    return (
        files.select("path", strip(decoded).alias("text"))
        .filter(F.col("text") != "")
        .select("path", F.lit(0).alias("block_idx"), F.lit(None).cast("int").alias("page_number"), "text")
    )


def parsed_blocks(files: DataFrame, parsers: dict[str, Callable[[bytes, str], Iterable[dict]]]) -> DataFrame:
    """Blocks from user parsers chosen by suffix.

    A parser takes (bytes, path) and yields ``{"text": ..., "page_number": ...}``. A file
    whose parser fails gives one row with ``_error`` set, so the job goes on.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, suffix = [], "." + path.rsplit(".", 1)[-1].lower()
                try:
                    for i, b in enumerate(parsers[suffix](bytes(content), path)):
                        body = (b.get("text") or "").strip()
                        if body:
                            rows.append((path, i, b.get("page_number"), body, None))
                except Exception as exc:  # one bad file must not stop the rest
                    rows = [(path, 0, None, None, f"{type(exc).__name__}: {exc}")]
                out = pd.DataFrame(rows, columns=list(BLOCK_FIELDS))
                yield out.astype({"page_number": "Int32"})

    wanted = files.filter(suffix_of("path").isin(*parsers)).select("path", "content")
    return wanted.mapInPandas(run, BLOCK)


def safe_stem(name) -> Column:
    """File stem with only letters, digits, ``-`` and ``_``, at most 64 characters, ``upload`` if nothing is left."""
    c = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^./]*$", "")
    kept = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-]", ""), 1, 64)
    return F.when(kept == "", F.lit("upload")).otherwise(kept)


def admit_uploads(files: DataFrame, name: str = "path", size: str = "length",
                  max_bytes: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds ``reject_reason`` (null = accepted) and the sanitised ``stored_name``."""
    suffix = suffix_of(name)
    return files.withColumn(
        "reject_reason",
        F.when(F.coalesce(F.col(size), F.lit(0)) == 0, "empty")
        .when(F.col(size) > max_bytes, f"exceeds {max_bytes} bytes")
        .when(~suffix.isin(*fixed.UPLOAD_SUFFIXES), "unsupported type"),
    ).withColumn("stored_name", F.when(F.col("reject_reason").isNull(), F.concat(safe_stem(name), suffix)))
