"""Pairs of overlapping spans, by bins of several widths.

A span of up to 2^l places has level l and lies in at most two bins of that width. A pair
meets at the larger of its two levels, where both spans lie in at most two bins each: in an
equi-join on (keys, level, bin). Spans that meet in a bin are of its width on one side, so
what is compared stays in proportion to what overlaps, long spans are not cut into many
bins, and a document with very many spans is spread over tasks by its bins. A pair comes
out once, in the bin in which its common part begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.util import settle


def _level(start: str, end: str) -> Column:
    """The least l with end - start <= 2^l; empty and inverted spans count as one place."""
    size = F.greatest(F.col(end) - F.col(start), F.lit(1))
    return F.length(F.bin((size - 1).cast("bigint"))) - (size == 1).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of both sides with equal ``on`` columns whose spans [start, end) overlap: each starts before the other ends.

    The other columns of both sides must have different names. Nulls match nothing; repeated
    rows pair as often as they come.
    """
    settle(left.sparkSession)
    (ls, le), (rs, re) = left_span, right_span
    left, right = left.withColumn("_l1", _level(ls, le)), right.withColumn("_l2", _level(rs, re))
    levels = {r[0] for side, l in ((left, "_l1"), (right, "_l2")) for r in side.select(l).distinct().collect() if r[0] is not None}  # 64 at most
    upwards = F.filter(F.array(*[F.lit(x) for x in sorted(levels)]) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("_l"))

    def binned(side: DataFrame, level: str, start: str, end: str) -> DataFrame:
        each = side.withColumn("_l", F.col(level)).withColumn("_level", F.explode(upwards)).drop("_l")
        width = F.pow(F.lit(2.0), F.col("_level")).cast("bigint")
        first = F.floor(F.col(start) / width)
        last = F.greatest(first, F.floor((F.col(end) - 1) / width))
        return each.withColumn("_bin", F.explode(F.sequence(first, last)))

    a, b = binned(left, "_l1", ls, le), binned(right, "_l2", rs, re)
    met = a.join(b, [*on, "_level", "_bin"]).filter(
        (F.greatest("_l1", "_l2") == F.col("_level")) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
        & (F.floor(F.greatest(ls, rs) / F.pow(F.lit(2.0), F.col("_level")).cast("bigint")) == F.col("_bin")))
    return met.drop("_l1", "_l2", "_level", "_bin")
