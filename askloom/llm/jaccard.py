"""Near-duplicate documents by the Jaccard similarity of their word n-gram sets, exactly.

The join is a grouped prefix join. All sets share one order of n-grams; two sets of
similarity t or more must have an n-gram in common among the first |x| - ceil(t |x|) + 1 of
each. The steps, each a Spark job over written tables:

1. Each text becomes its set of 64-bit n-gram hashes (numpy, per Arrow batch). The order is by
   hash, with the most frequent n-grams last: the beginnings of all sets are counted, then the
   rest of those sets whose prefix, without frequent n-grams, would reach beyond. The ``_HOT``
   most frequent of each count form a table of fixed size. Any order gives the same result;
   this one keeps passages that many documents share out of the prefixes.
2. Equal sets are one node. Nodes of equal prefix and size form a group, and the group's
   leader stands for it where the prefix tokens are joined; members are verified against it.
3. Rounds. Each token's groups are dealt by a hash of the round into hands of at most
   ``_HANDS`` on average, and the groups of a hand are paired unless connected already. Pairs of
   too different size, or that share too few prefix n-grams for the threshold, are dropped;
   the rest is verified on whole sets. A token of few groups is done after the first round;
   a family of thousands of near copies is connected after a few, with some pairs per member
   in each, though most of its members may not be similar to any one of them.
4. Full step. Of the tokens whose nodes are still not all connected, groups are expanded and
   every pair of nodes of different components is filtered and verified, once for all tokens
   that both have; a token's largest component is not paired with itself. Nothing is sampled
   and no bucket is capped, so no link between components is lost; pairs inside a component,
   which cannot change the result, are never formed.

Defined results: a text with fewer than ``n`` words is its whole word sequence as one n-gram;
a text that is null or has no words is empty and linked with nothing; equal rows are linked
(similarity 1). A null key cannot be looked up again: such a row is linked with equal sets only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom import util
from askloom.llm import graph, spans

_HOT = 1 << 18
_HOT_LEAST = 50
_HANDS = (32, 64, 256)


def sets_of(raw: np.ndarray, at: np.ndarray, n: int, hot: np.ndarray) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text in the common order (frequent ones last)."""
    raw = spans.LOWER[raw]
    starts, ends, offsets = spans.words(raw, at)
    word = spans.hashes(raw, starts, ends)
    gram = spans.grams(word, n) >> np.uint64(1)
    if len(hot) and len(gram):
        place = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
        gram |= (hot[place] == gram).astype(np.uint64) << np.uint64(63)
    out = []
    cut = offsets.tolist()
    for a, b in zip(cut, cut[1:]):
        if b - a >= n:
            s = np.sort(gram[a:b - n + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(spans.grams(word[a:b], b - a) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(s: np.ndarray) -> int:
    """A signed 64-bit number for a whole set, the frequent mark left out."""
    plain = s & np.uint64((1 << 63) - 1)
    total = spans.mixed(np.array([np.sum(spans.mixed(plain + np.uint64(1)), dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(total.view(np.int64)[0])


def _prefix(n: Column | int, num: int, den: int):
    """Length of the prefix of a set of n n-grams."""
    if isinstance(n, int):
        return n - -(-num * n // den) + 1
    return n - F.ceil(n * num / den) + 1


def _counted(docs: DataFrame, n: int, num: int, den: int, text: str, hot: np.ndarray | None = None) -> np.ndarray:
    """The most frequent n-grams, sorted, of the first two prefixes' length of each set in plain order.

    With ``hot``, of the rest of those sets that have less than a prefix of other n-grams there.
    """
    sent = None if hot is None else docs.sparkSession.sparkContext.broadcast(hot)

    def part(s: np.ndarray) -> np.ndarray:
        p = _prefix(len(s), num, den)
        if sent is None:
            return s[:2 * p]
        known = sent.value
        if len(known) == 0 or len(s) <= 2 * p:
            return s[:0]
        frequent = known[np.minimum(np.searchsorted(known, s[:2 * p]), len(known) - 1)] == s[:2 * p]
        return s[2 * p:] if 2 * p - frequent.sum() < p else s[:0]

    def run(batches):
        none = np.zeros(0, np.uint64)
        for b in batches:
            for _, _, raw, at in spans.pieces(b.column(0)):
                parts = [x for x in map(part, sets_of(raw, at, n, none)) if len(x)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["token"])

    tokens = docs.select(docs[text].alias("t")).mapInArrow(run, "token long")
    frequent = tokens.groupBy("token").count().filter(F.col("count") >= _HOT_LEAST)
    top = frequent.orderBy(F.desc("count"), "token").limit(_HOT).select("token").toArrow()
    return np.sort(np.array(top.column(0).to_numpy(), np.int64).view(np.uint64))


def _described(docs: DataFrame, n: int, num: int, den: int, hot: np.ndarray, key: str, text: str) -> DataFrame:
    """(k, n_shingles, node, prefix) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # 2 * _HOT numbers at most

    def run(batches):
        for b in batches:
            for lo, hi, raw, at in spans.pieces(b.column(1)):
                sets = sets_of(raw, at, n, sent.value)
                prefixes = [s[:_prefix(len(s), num, den)] for s in sets]
                cut = np.cumsum([0, *map(len, prefixes)])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(size), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.view(np.int64)))], ["k", "n_shingles", "node", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n_shingles long, node long, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(node, s): whole sets of the wanted nodes (node, rep), read from their representatives' texts."""
    def run(batches):
        none = np.zeros(0, np.uint64)
        for b in batches:
            for _, _, raw, at in spans.pieces(b.column(0)):
                sets = [s for s in sets_of(raw, at, n, none) if len(s)]
                if sets:
                    cut = np.cumsum([0, *map(len, sets)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([_node(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "s"])

    reps = util.broadcast_if(wanted.select(F.col("rep").alias(key)).distinct(), wanted)
    texts = docs.select(key, text).join(reps, key, "left_semi").select(text)
    return texts.mapInArrow(run, "node long, s array<long>").join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))


def _near(nx: Column, ny: Column, num: int, den: int) -> Column:
    return F.least(nx, ny) * den >= F.greatest(nx, ny) * num


def _early(nx: str, ny: str, early_x: str, early_y: str) -> Column:
    return (F.col(early_x) & (F.col(nx) <= F.col(ny))) | (F.col(early_y) & (F.col(ny) <= F.col(nx)))


def _enough(c: Column, nx: Column, ny: Column, num: int, den: int) -> Column:
    """Shared prefix tokens that a similar pair must have, given both sizes."""
    most_left = F.greatest(nx - _prefix(nx, num, den), ny - _prefix(ny, num, den))
    return c >= F.ceil((nx + ny) * num / (num + den)) - most_left


class _Checker:
    """Verifies pairs of nodes on their whole sets, which are read once and kept in written tables."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int, key: str, text: str):
        self.docs, self.nodes, self.how = docs, nodes, (n, key, text)
        self.num, self.den = num, den
        self.held: DataFrame | None = None

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose prefixes share enough."""
        known = self.nodes.select("node", "n", "prefix")
        left = pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa")), "a")
        both = left.join(known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb")), "b")
        common = F.size(F.array_intersect("pa", "pb"))
        return both.filter(_near(F.col("na"), F.col("nb"), self.num, self.den) & _enough(common, F.col("na"), F.col("nb"), self.num, self.den)).select("a", "b")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The similar ones among the written pairs, as a written table."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        new = self.nodes.join(ends, "node", "left_semi")
        if self.held is not None:
            new = new.join(self.held.select("node"), "node", "left_anti")
        wanted = util.staged(new.select("node", "rep"), "wanted")
        if self.held is None or not wanted.isEmpty():
            sets = util.staged(_sets(self.docs, wanted, *self.how), "sets")
            self.held = sets if self.held is None else self.held.unionByName(sets)
        left = pairs.join(self.held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(self.held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return util.staged(both.filter(common * self.den >= (F.size("sa") + F.size("sb") - common) * self.num).select("a", "b"), "verified")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) of all nodes after more links (a, b); only components are linked, not nodes."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    merged = graph.components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    into = merged.select(F.col("node").alias("label"), F.col("label").alias("into"))
    return util.staged(labels.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")


def _joined(labels: DataFrame, checker: _Checker, pairs: DataFrame) -> DataFrame:
    """The labels after the similar ones among the written pairs; where there are none, nothing more is planned or run."""
    if pairs.isEmpty():
        return labels
    links = checker.similar(pairs)
    return labels if links.isEmpty() else _relabelled(labels, links)


def _across(rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of different labels and near sizes that share a bucket in which the one that is not larger is early, and enough of their prefixes.

    ``rows``: bucket, node, n, label, early. A bucket's most frequent label is not paired with
    itself: the nodes of its other labels look up all nodes. A pair comes out of one bucket
    only, the first that will do, however many both nodes are in. A node is in as many
    buckets as its prefix is long, at most.
    """
    mine = rows.groupBy("node").agg(F.collect_list("bucket").alias("o"), F.collect_list(F.when(F.col("early"), F.col("bucket"))).alias("e"))
    main = rows.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    told = rows.join(mine.join(nodes.select("node", "prefix"), "node"), "node").join(main, "bucket")
    x, y = told.filter("label <> main").alias("x"), told.alias("y")
    fewer, more = F.col("x.n") <= F.col("y.n"), F.col("y.n") <= F.col("x.n")
    none = F.array().cast("array<bigint>")
    first = F.array_min(F.array_union(
        F.when(fewer, F.array_intersect("x.e", "y.o")).otherwise(none), F.when(more, F.array_intersect("y.e", "x.o")).otherwise(none)))
    meet = (
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & _near(F.col("x.n"), F.col("y.n"), num, den) & _early("x.n", "y.n", "x.early", "y.early") & (F.col("x.bucket") == first)
        & _enough(F.size(F.array_intersect("x.prefix", "y.prefix")), F.col("x.n"), F.col("y.n"), num, den))
    return x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (least key of its component).

    Two documents are linked when common n-grams * den >= joint n-grams * num.
    """
    spark = util.settle(docs.sparkSession)
    begun = _counted(docs, n, num, den, text)
    hot = np.union1d(begun, _counted(docs, n, num, den, text, begun))

    described = util.staged(_described(docs, n, num, den, hot, key, text), "described")
    some = described.filter(F.col("node").isNotNull())
    nodes = util.staged(some.groupBy("node").agg(
        F.min("k").alias("rep"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")
    ).withColumn("group", F.xxhash64("prefix", "n")), "nodes")

    leaders = nodes.groupBy("group").agg(F.min("node").alias("leader"))
    groups = util.staged(nodes.join(leaders, "group").select("node", "n", "leader"), "groups")
    # of two similar sets the one that is not larger has a common n-gram already in this shorter prefix
    brief = F.col("n") - F.ceil(F.col("n") * 2 * num / (num + den)) + 1
    led = nodes.join(groups.filter(F.col("node") == F.col("leader")).select("node"), "node", "left_semi")
    posting = led.select(F.col("node").alias("leader"), "n", F.posexplode("prefix").alias("pos", "token"), brief.alias("brief")).select(
        "leader", "n", "token", (F.col("pos") < F.col("brief")).alias("early"))
    crowd = posting.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    shared = util.staged(posting.join(crowd, "token"), "postings")
    checker = _Checker(docs, nodes, n, num, den, key, text)
    inner = groups.filter(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    several = groups.groupBy("leader").agg(F.count("*").alias("m")).filter("m > 1").select("leader")
    labels = nodes.select("node", F.col("node").alias("label"))
    for turn, size in enumerate(_HANDS):
        live = shared.withColumn("label", F.col("leader"))
        if turn:
            known = shared.filter(F.col("c") > _HANDS[0]).join(labels.withColumnRenamed("node", "leader"), "leader")
            mixed = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
            live = util.staged(known.join(mixed, "token"), "live")
            if live.isEmpty():
                break
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / size))).cast("int")
        hand = F.pmod(F.xxhash64("leader", F.lit(turn)), F.pow(F.lit(2), bits).cast("long"))
        dealt = live.select("token", hand.alias("hand"), "leader", "n", "label", "early")
        x, y = dealt.alias("x"), dealt.alias("y")
        meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.hand") == F.col("y.hand")) & (F.col("x.leader") < F.col("y.leader"))
        met = x.join(y, meet & (F.col("x.label") != F.col("y.label")) & _near(F.col("x.n"), F.col("y.n"), num, den) & _early("x.n", "y.n", "x.early", "y.early"))
        pairs = checker.candidates(met.select(F.col("x.leader").alias("a"), F.col("y.leader").alias("b")).distinct())
        labels = _joined(labels, checker, util.staged(pairs if turn else pairs.unionByName(inner), "pairs"))

    member = util.staged(groups.join(labels, "node").select("node", "n", "leader", "label"), "members")
    # tokens that were not paired in full: of many groups, or with a group of several members
    wide = shared.join(several.withColumn("m", F.lit(True)), "leader", "left").filter((F.col("c") > _HANDS[0]) | F.col("m")).select("token").distinct()
    keyed = shared.join(wide, "token").select(F.col("token").alias("bucket"), "leader", "early").join(member, "leader").select("bucket", "node", "n", "label", "early")
    mixed = keyed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    open_ = keyed.join(mixed, "bucket")
    # members of one group share the whole prefix: one bucket more for groups that are not connected
    inside = member.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("leader")
    apart = member.join(inside, "leader").select(F.col("leader").alias("bucket"), "node", "n", "label", F.lit(True).alias("early"))
    open_ = util.staged(open_.select("bucket", "node", "n", "label", "early").unionByName(apart), "open")
    if not open_.isEmpty():
        crossing = _across(open_, nodes, num, den)
        ordered = crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = _joined(labels, checker, util.staged(ordered, "pairs"))

    whole = nodes.select("node", "rep").join(labels, "node")
    least = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "label").select("node", "component_id")
    return described.join(named, "node", "left").select(F.col("k").alias(key), "n_shingles", F.coalesce("component_id", "k").alias("component_id"))
