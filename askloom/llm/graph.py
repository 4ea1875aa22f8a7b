"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom import util


def _towards_least(links: DataFrame, smaller_only: bool) -> DataFrame:
    """One star step on links (a, b): each node hands its least neighbour on to its other neighbours.

    Small step: to its smaller neighbours and itself. Large step: to its larger neighbours.
    Links come out as they go in, distinct and from the larger node to the smaller one.
    """
    both = links if smaller_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if smaller_only:
        out = joined.select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _all_stars(links: DataFrame) -> bool:
    """Every node has one link to a smaller node, or only links to larger ones."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b) of type long; the label is the least node reached.

    Alternating large and small star steps; each round is a written table, and the number of
    rounds grows with the logarithm of the longest chain. Links that are stars already, or none,
    take no round. Links to itself and nulls are ignored.
    """
    util.settle(links.sparkSession)
    ordered = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = util.staged(ordered, "links")
    while not _all_stars(now):
        now = util.staged(_towards_least(_towards_least(now, smaller_only=False), smaller_only=True), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
