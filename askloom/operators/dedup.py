"""Near-duplicate chunks: the first of similar chunks is kept, the later ones go.

A chunk is dropped only when it is similar to an earlier chunk that was itself kept, so
"drop whatever has an earlier match" would be wrong on chains. The decision is made in
rounds over the first members of each bucket:

* rows with the same set of shingles are folded into one node first, so a group of copies
  of any size is one row here;
* the first undecided members of a bucket are compared with its later members, as many as
  the round's block holds;
* a node with nothing undecided before it is kept unless a kept one resembles it, and what
  a kept one resembles is dropped; the rest goes into the next round.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions import text as tx
from askloom.operators import shingles
from askloom.util import BROADCAST_LIMIT, balanced, broadcast_if, cut_lineage, fits, staged, top_per_group


def shingle_sets(chunks: DataFrame, key: str, text: str = "text", n: int = fixed.SHINGLE_WORDS) -> DataFrame:
    """(key, shingles, sig): distinct shingle hashes per row, and a hash of the whole set."""
    hashes = F.array_sort(F.array_distinct(F.transform(tx.word_shingles(text, n), lambda s: F.xxhash64(s))))
    return (
        balanced(chunks.select(key, text)).filter(F.col(text).rlike(r"\S")).select(F.col(key).alias("key"), hashes.alias("shingles"))
        .withColumn("sig", F.sha2(F.array_join(F.transform("shingles", lambda x: x.cast("string")), ","), 256))
    )


def representatives(sets: DataFrame) -> DataFrame:
    """One node per distinct shingle set, named by its smallest key."""
    return sets.groupBy("sig").agg(F.min("key").alias("node"), F.first("shingles").alias("shingles"))


#: shingles that stand in so many prefixes go last in the common order, the most frequent ones of a round
HOT_LEAST, HOT_MOST = 50, 1 << 18


class Prefixes:
    """Sets held as prefixes only; whole sets are made from the texts again, for the pairs that prefixes leave.

    Sets with Jaccard >= ``threshold`` share at least ceil(t * size) members, so they meet
    among the first size - ceil(t * size) + 1 members of a common order. The order is by hash
    with frequent members last, so text that very many chunks carry is not a bucket unless a
    chunk has nothing else. Any order gives the same result: prefixes are made without
    frequent members first, counted, and only those that hold a frequent one are made again, twice.
    What is written and shuffled are the prefixes, a 1 - t part of the shingles.
    """

    def __init__(self, chunks: DataFrame, key: str, text: str, threshold: float, n: int = fixed.SHINGLE_WORDS):
        self.threshold, self.n, self.kind = threshold, n, chunks.schema[key].dataType.simpleString()
        self.texts = chunks.filter(F.col(text).rlike(r"\S")).select(F.col(key).alias("key"), F.lower(text).alias("text"))
        none = np.zeros(0, np.uint64)
        made = self._described(balanced(self.texts, BROADCAST_LIMIT), none)
        rows = staged(made.withColumn("row", F.monotonically_increasing_id()), "prefixes")
        if not rows.groupBy("key").count().filter("count > 1").isEmpty():
            self.texts = self.texts.dropDuplicates()  # a repeated row is one node
        first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "row"))).alias("m")
        named = rows.groupBy("s1", "s2").agg(first).select("s1", "s2", F.col("m.key").alias("node"), F.col("m.row").alias("first"))
        self.owners = staged(rows.select("key", "row", "s1", "s2").join(named, ["s1", "s2"]).select("key", "node", "row", "first"), "owners")
        copies = staged(self.owners.filter(~F.col("row").eqNullSafe(F.col("first"))).select("row"), "copies")
        self.nodes = rows.join(broadcast_if(copies), "row", "left_anti").select(F.col("key").alias("node"), "n", "prefix")
        hot, made = none, self.nodes
        for _ in range(2):
            new = np.setdiff1d(self._frequent(made), hot)
            if not len(new):
                break
            hot = np.sort(np.concatenate([hot, new]))
            made = self._remake(hot, new)

    def _described(self, texts: DataFrame, hot: np.ndarray) -> DataFrame:
        n, t, sent = self.n, self.threshold, texts.sparkSession.sparkContext.broadcast(hot)
        return texts.mapInArrow(lambda batches: shingles.described(batches, n, t, sent.value), f"key {self.kind}, n long, s1 long, s2 long, prefix array<long>")

    @staticmethod
    def _frequent(nodes: DataFrame) -> np.ndarray:
        count = nodes.select(F.explode("prefix").alias("h")).filter("h >= 0").groupBy("h").agg(F.count("*").alias("c"))
        top = count.filter(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "h").limit(HOT_MOST).select("h").toArrow()
        return top.column(0).to_numpy().astype(np.int64).view(np.uint64)

    def _remake(self, hot: np.ndarray, new: np.ndarray) -> DataFrame:
        """Prefixes in the order with ``hot`` last; one that holds none of ``new`` stays as it is."""
        sent = self.nodes.sparkSession.sparkContext.broadcast(new)

        def holding(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in batches:
                lists = b.column("prefix")
                known = shingles.marked(np.asarray(lists.flatten()).view(np.uint64) & np.uint64(2**63 - 1), sent.value) >> np.uint64(63)
                ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                yield b.filter(pa.array(np.add.reduceat(known, ends[:-1]) > 0)).select(["node"])  # no prefix is empty

        again = staged(self.nodes.select("node", "prefix").mapInArrow(holding, f"node {self.kind}"), "again")
        ids = broadcast_if(again)
        texts = self.texts.join(ids.withColumnRenamed("node", "key"), "key", "left_semi")
        made = staged(self._described(texts, hot).select(F.col("key").alias("node"), "n", "prefix"), "again")
        kept = self.nodes.join(ids, "node", "left_anti")
        self.nodes = (kept if fits(again) else staged(kept, "nodes")).unionByName(made)
        return made

    def keys(self) -> DataFrame:
        """(node, band, n, at): the buckets of more than one member that a node is in, and where in its prefix."""
        rows = self.nodes.select("node", "n", F.posexplode("prefix").alias("at", "band"))
        return staged(rows.withColumn("c", F.count("*").over(Window.partitionBy("band"))).filter("c > 1").drop("c"), "keys")

    def sizes(self) -> DataFrame:
        return self.nodes.select("node", "n")

    def verified(self, pairs: DataFrame, threshold: float) -> DataFrame:
        """(kept, node, jaccard): prefixes must share what sets of their sizes need, then whole sets decide."""
        pairs = cut_lineage(pairs)
        side = lambda node, i: _needed(self.nodes.select(F.col("node").alias(node), F.col("n").alias(f"n{i}"), F.col("prefix").alias(f"p{i}")), node, pairs)
        both = broadcast_if(pairs, factor=4).join(side("kept", 1), "kept").join(side("node", 2), "node")
        after = F.greatest(F.col("n1") - F.size("p1"), F.col("n2") - F.size("p2"))
        likely = both.filter(F.size(F.array_intersect("p1", "p2")) + after >= _common("n1", "n2", threshold))
        likely = cut_lineage(likely.select("kept", "node"))
        ids = likely.select(F.explode(F.array("kept", "node")).alias("key")).distinct()
        n, texts = self.n, self.texts.join(broadcast_if(ids, likely, 4), "key", "left_semi")
        sets = cut_lineage(texts.mapInArrow(lambda batches: shingles.whole(batches, n), f"node {self.kind}, shingles array<long>"))
        return verified(likely, sets, threshold)


def _needed(rows: DataFrame, side: str, pairs: DataFrame) -> DataFrame:
    """The rows that stand on this side of a pair, without a shuffle; all rows if the pairs are many."""
    return rows.join(F.broadcast(pairs.select(side).distinct()), side, "left_semi") if fits(pairs, 4) else rows


def _common(n1: str, n2: str, threshold: float) -> Column:
    """Members that two sets of these sizes have in common at least."""
    return (F.col(n1) + F.col(n2)) * F.lit(threshold / (1 + threshold)) - 1e-6


def _placed(n1: str, at1: str, n2: str, at2: str, threshold: float) -> Column:
    """Can sets that share the member at these places be alike? Before and after it, no more can be common than either has."""
    return F.least(at1, at2) + F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2)) >= _common(n1, n2, threshold)


def band_rows(threshold: float, permutations: int, miss: float = 1e-3) -> int:
    """Longest slice of a signature with which a pair at the threshold is missed with at most ``miss``."""
    fits = [r for r in range(1, permutations + 1) if (1 - threshold ** r) ** (permutations // r) <= miss]
    return max(fits, default=1)


def minhash_keys(nodes: DataFrame, threshold: float, permutations: int = fixed.MINHASH_PERMUTATIONS, seed: int = 42) -> DataFrame:
    """(node, band) from a MinHash signature cut into slices; only the keys are shuffled later.

    The slices are as long as the threshold allows, so that unlike texts seldom meet.
    Signatures are made in Arrow batches: one vectorised pass over a batch's shingles per
    permutation, then a segment minimum.
    """
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**63, size=permutations, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, size=permutations, dtype=np.uint64)
    rows = band_rows(threshold, permutations)
    bands = permutations // rows

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("shingles")
            starts = np.asarray(column.offsets)[:-1] - column.offsets[0].as_py()
            h = np.asarray(column.flatten()).view(np.uint64)
            sig = np.empty((batch.num_rows, permutations), dtype=np.uint64)
            for i in range(permutations):
                v = h * mult[i] + add[i]
                v ^= v >> np.uint64(29)
                sig[:, i] = np.minimum.reduceat(v * mult[i], starts)
            flat = pa.array(sig.view(np.int64).reshape(-1))
            offsets = pa.array(np.arange(0, sig.size + 1, permutations, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, flat)], ["node", "mh"])

    node_type = dict(nodes.dtypes)["node"]
    signed = nodes.select("node", "shingles").mapInArrow(sign, f"node {node_type}, mh array<bigint>")
    slices = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("mh", b * rows + 1, rows)))
    return signed.select("node", F.explode(slices).alias("band"))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(kept, node, jaccard) of those pairs whose exact Jaccard reaches the threshold.

    Few pairs go to the sets of their kept nodes, so that only these are shuffled to the others.
    """
    s1 = nodes.select(F.col("node").alias("kept"), F.col("shingles").alias("s1"))
    s2 = _needed(nodes.select("node", F.col("shingles").alias("s2")), "node", pairs)
    scored = broadcast_if(pairs, factor=4).join(s1, "kept").join(s2, "node").select("kept", "node", jaccard(F.col("s1"), F.col("s2")).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= threshold)


class Sets:
    """Nodes with their shingles at hand."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def sizes(self) -> DataFrame:
        return self.nodes.select("node", F.size("shingles").alias("n"))

    def verified(self, pairs: DataFrame, threshold: float) -> DataFrame:
        return verified(pairs, self.nodes, threshold)


def resolved(edges: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) nodes: the keep-first rule over verified edges (kept < node).

    ``ready`` are the nodes all of whose earlier candidates are among the edges; only they
    may be kept. One pass per link of the longest chain of similar nodes.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], ready.schema)
    kept, dropped, open_ = none, none, edges
    while True:
        sure = cut_lineage(ready.join(open_.select("node").distinct(), "node", "left_anti"))
        if sure.isEmpty():
            return kept, dropped
        lost = cut_lineage(open_.join(sure.withColumnRenamed("node", "kept"), "kept", "left_semi").select("node").distinct())
        kept, dropped = kept.unionByName(sure), dropped.unionByName(lost)
        done = sure.unionByName(lost)
        ready = cut_lineage(ready.join(done, "node", "left_anti"))
        open_ = cut_lineage(open_.join(done.withColumnRenamed("node", "kept"), "kept", "left_anti").join(lost, "node", "left_anti"))


def dropped_nodes(nodes: Sets | Prefixes, keys: DataFrame, threshold: float, blocks: tuple[int, ...] = (1, 32, 1024), rounds: list | None = None) -> DataFrame:
    """The nodes that keep-first removes. Exact: rounds run until nothing is undecided.

    In each round the first few undecided members of every bucket (its block) are compared
    with the bucket's later members of similar size. The block is one member in the first
    round, where copies of one text all go, and grows, so a bucket of members that resemble
    each other just too little is done in a few rounds; ``blocks`` bounds the pairs a row is
    in per bucket and round. A node is decided when it stands in the block of each of its
    buckets, so that nothing earlier is unknown; buckets left with one member vanish.
    ``rounds`` collects the number of undecided rows per round.
    """
    spark = keys.sparkSession
    live = keys
    if "n" not in keys.columns:
        sizes = keys.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
        live = cut_lineage(keys.join(nodes.sizes(), "node").join(sizes, "band", "left_semi").select("node", "band", "n"))
    placed = "at" in live.columns
    gone = spark.createDataFrame([], f"node {dict(keys.dtypes)['node']}")
    step = 0
    while not live.isEmpty():
        width = blocks[min(step, len(blocks) - 1)]
        step += 1
        if rounds is not None:
            rounds.append(live.count())
        block = cut_lineage(top_per_group(live, ["band"], [F.asc("node")], width).drop("rank"))
        edges = cut_lineage(nodes.verified(met(block, live, threshold, placed).filter("kept < node").distinct(), threshold).select("kept", "node"))
        standing = live.select("node", F.lit(1).alias("all"), F.lit(0).alias("first")).unionByName(block.select("node", F.lit(0).alias("all"), F.lit(1).alias("first")))
        ready = standing.groupBy("node").agg(F.sum("all").alias("all"), F.sum("first").alias("first")).filter("all = first").select("node")
        kept, lost = resolved(edges, cut_lineage(ready))
        rest = live.join(kept.unionByName(lost), "node", "left_anti")
        crowded = rest.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
        live = cut_lineage(rest.join(crowded.select("band"), "band", "left_semi"))
        gone = gone.unionByName(lost)  # a union of written tables
    return gone


def met(first: DataFrame, second: DataFrame, threshold: float, placed: bool) -> DataFrame:
    """(kept, node) of the members of one bucket whose sizes, and places in their prefixes, allow the threshold."""
    names = {"node": "kept", "n": "n1"} | ({"at": "at1"} if placed else {})
    pairs = first.select("band", *[F.col(c).alias(x) for c, x in names.items()]).join(second, "band")
    near = F.least("n", "n1") >= threshold * F.greatest("n", "n1") - 1e-9
    return pairs.filter(near & _placed("n1", "at1", "n", "at", threshold) if placed else near).select("kept", "node")


def keep_first(chunks: DataFrame, key: str, text: str = "text", threshold: float = fixed.DEDUP_THRESHOLD,
               exact: bool = False) -> DataFrame:
    """(key, kept): which rows stay. MinHash candidates by default, the exact prefix filter on request.

    Rows without any shingle (empty texts) stay.
    """
    if exact:
        nodes = Prefixes(chunks, key, text, threshold)
        keys, sets = nodes.keys(), nodes.owners.select("key")
    else:
        sets = staged(shingle_sets(chunks, key, text), "shingles")
        held = staged(representatives(sets), "nodes")
        nodes, keys = Sets(held), minhash_keys(held, threshold)
    gone = dropped_nodes(nodes, keys, threshold)
    stay = nodes.sizes().join(gone, "node", "left_anti").select(F.col("node").alias("key"))
    empty = chunks.select(F.col(key).alias("key")).join(sets.select("key"), "key", "left_anti")
    kept = stay.unionByName(empty).withColumn("_k", F.lit(True))
    return chunks.select(F.col(key).alias("key")).join(kept, "key", "left").select(
        F.col("key").alias(key), F.coalesce("_k", F.lit(False)).alias("kept")
    )


def removal_pairs(chunks: DataFrame, key: str, text: str = "text", threshold: float = 0.85) -> DataFrame:
    """(kept, dropped, jaccard): every removed row with the kept rows it is similar to.

    Copies are paired with nodes, not with each other, so the output grows with the rows.
    """
    nodes = Prefixes(chunks, key, text, threshold)
    keys = nodes.keys()
    gone = cut_lineage(dropped_nodes(nodes, keys, threshold))
    pairs = met(keys.join(gone, "node", "left_anti"), keys.join(gone, "node", "left_semi"), threshold, placed=True)
    near = nodes.verified(pairs.distinct(), threshold)
    stay = nodes.sizes().join(gone, "node", "left_anti").select(F.col("node").alias("kept"), "node", F.lit(1.0).alias("jaccard"))
    return nodes.owners.select("key", "node").join(near.unionByName(stay), "node").filter("key != kept").select("kept", F.col("key").alias("dropped"), "jaccard")


def dedup_stats(chunks: DataFrame, marks: DataFrame, key: str, doc: str) -> DataFrame:
    """docs_seen, chunks_produced, dupes_removed in one aggregate."""
    return chunks.select(key, doc).join(marks, key).agg(
        F.countDistinct(doc).alias("docs_seen"),
        F.count_if("kept").alias("chunks_produced"),
        F.count_if(~F.col("kept")).alias("dupes_removed"),
    )
