"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once over each whole text and stores the measurements and
one bit per failed rule. Policies are versioned masks over those bits: applying another
policy, or asking what a rule costs, reads the ledger and no text. ``ablation`` needs one row
per distinct bit pattern (at most 2 to the number of rules), summed before the shuffle.

Defined results: a null or empty text has no words and fails ``few_words``; equal rows are
judged alike; extra columns pass through untouched and none of their names matter, as only
the key and the text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import spans

# Symbol characters that are counted.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[ord("a"):ord("z") + 1] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_ascii_letters"]

#: name, condition over the measures; the position is the bit and never changes, new rules go to the end
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "100 * n_symbols > 25 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("capitals", "100 * n_upper > 70 * n_ascii_letters"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: version -> names of the rules that a kept document must pass
POLICIES = {
    1: ["few_words", "repeated_words"],
    2: ["few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words", "capitals"],
}
BASE, CURRENT = 1, 2


def mask(version: int) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def repeated(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mask of the values found more than once in their row."""
    codes, found = pd.factorize(values ^ spans.mixed(rows.astype(np.uint64) + np.uint64(1)))
    return (np.bincount(codes, minlength=len(found)) > 1)[codes]


def measured(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The measures of each text, in the order of MEASURES."""
    starts, ends, offsets = spans.words(raw, at)
    n_words = np.diff(offsets)
    inside = ~spans.WHITE[raw]
    word_chars = spans.counts(inside & ((raw & 0xC0) != 0x80), at)
    line_starts, line_ends, line_offsets = _lines(raw, at)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_rows = spans.rows_of(line_offsets)[with_word]
    line_key = spans.hashes(raw, line_starts[with_word], line_ends[with_word]) ^ spans.mixed(line_rows.astype(np.uint64) + np.uint64(1))
    codes, _ = pd.factorize(line_key)
    again = np.diff(np.maximum.accumulate(codes), prepend=-1) == 0 if len(codes) else np.zeros(0, bool)
    n = len(at) - 1
    triple = spans.grams(spans.hashes(raw, starts, ends), 3)
    whole = spans.whole_grams(offsets, 3)
    twice = np.zeros(len(starts), bool)
    place = np.flatnonzero(whole)
    place = place[repeated(triple[place], spans.rows_of(offsets)[place])]
    for j in range(3):
        twice[place + j] = True
    return [n_words, word_chars, spans.counts(_SYMBOL[raw], at), np.bincount(line_rows, minlength=n), np.bincount(line_rows[again], minlength=n),
            spans.counts(twice, offsets), spans.counts(_UPPER[raw], at), spans.counts(_ASCII_LETTER[raw], at)]


def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans between line feeds (without them); a text has one more line than line feeds."""
    feeds = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate([at[:-1], feeds + 1])
    ends = np.concatenate([at[1:], feeds])
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, feeds, side="right") - 1])
    order = np.lexsort((starts, row))
    ends = ends[np.lexsort((ends, row))]
    offsets = np.zeros(len(at), np.int64)
    np.cumsum(np.bincount(row, minlength=len(at) - 1), out=offsets[1:])
    return starts[order], ends, offsets


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measures, and ``failed`` with a bit for each failed rule."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, raw, at in spans.pieces(b.column(1)):
                columns = [pa.array(x, pa.int64()) for x in measured(raw, at)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], ["k", *MEASURES])

    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    return rows.withColumn("failed", failed.cast("long")).withColumnRenamed("k", key)


def judged(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    passed = F.col("failed").bitwiseAND(F.lit(mask(version))) == 0
    return rows.withColumns({"base_failed": base, "kept": ~base & passed})


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it removes.

    Also the OR and AND of the failure bits of the documents that fail the rule: the rules
    that ever, and that always, fail together with it.
    """
    under = F.col("failed").bitwiseAND(F.lit(mask(version)))
    patterns = rows.groupBy(under.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]])).alias("r")
    each = patterns.select("bits", "n", rules).select("bits", "n", "r.*").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return each.groupBy("rule", "bit").agg(
        F.sum("n").alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or("bits").alias("ever_with"), F.bit_and("bits").alias("always_with"))
