"""Nearest neighbours by collision counting over query-centred windows.

Vectors are dealt into shards. A shard keeps its vectors' values under ``m`` Gaussian
projections, each projection as one sorted array. A query centres a window on its own value
in every array, and a vector collides once for each window it lies in. Windows widen round
by round over the same arrays (virtual rehashing: only the newly covered ends are counted);
vectors that reach the collision threshold are verified by their exact cosine.

A round ends the search when a vector as near as the k-th best so far would have reached the
threshold with probability ``sure``: two unit vectors at distance s collide under a window of
half width h with probability P(|N(0, 1)| <= h / s), so the needed width follows from the k-th
distance. Clustered vectors stop after narrow windows; for vectors without structure, where
the k-th is hardly nearer than the rest, about half of a shard is verified.

Every row is indexed. Each shard is read once by one task, and the queries are streamed past
it, so neither a shard (at most ``rows_per_shard``) nor the queries need to fit anywhere
together; a shard answers a query with its k best, and these meet in one top-k.

Defined results: keys are integers, anything else is a ValueError; vectors that are null, zero
or hold null or non-finite values take no part, as queries or as candidates, and very large or
small components are brought into range first (by powers of two, so no cosine is rounded
otherwise); vectors of different length are never compared; a row that is
repeated counts once; of equal vectors only the k + 1 smallest ids can be among anybody's
nearest, so the others are set aside before the shuffle, which changes no result. A query id
with several vectors uses the smallest in array order. Rows of the query's own id are not
candidates. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, erf, lgamma, log, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from askloom import util

_DIM_SHIFT = 24


def _reach(m: int, least: int, p: float) -> float:
    """Probability of at least ``least`` collisions out of m."""
    log_choose = lambda i: lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)
    return sum(exp(log_choose(i) + i * log(p) + (m - i) * log(1 - p)) for i in range(least, m + 1))


@lru_cache(8)
def _half_width(m: int, least: int, sure: float) -> float:
    """Half width of the windows, per unit of distance, that catches a vector with probability ``sure``."""
    lo, hi = 1e-6, 6.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = min(max(erf(mid / sqrt(2)), 1e-12), 1 - 1e-12)
        lo, hi = (lo, mid) if _reach(m, least, p) >= sure else (mid, hi)
    return hi


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


class Shard:
    """The sorted projections of one shard, and its vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, seed: int):
        vectors = _scaled(vectors)
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.norms[:, None]
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        values = (self.unit @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def search(self, own: int, query: np.ndarray, k: int, least: int, sure: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, cosines, vectors verified) of the k best found."""
        n, m = len(self.ids), len(self.sorted)
        query = _scaled(query)
        norm = sqrt(float((query * query).sum()))
        unit = query / norm
        centre = unit @ self.axes
        reach = _half_width(m, least, sure)
        hits = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        done[self.ids == own] = True
        cosine = np.full(n, -np.inf)
        verified = 0
        lo = hi = None
        radius = 0.5  # distance of unit vectors that the windows are made for
        while True:
            a = [int(np.searchsorted(s, c - reach * radius)) for s, c in zip(self.sorted, centre)]
            b = [int(np.searchsorted(s, c + reach * radius, side="right")) for s, c in zip(self.sorted, centre)]
            if lo is None:
                fresh = [o[x:y] for o, x, y in zip(self.order, a, b)]
            else:
                fresh = [o[x:y] for o, x, y in zip(self.order, a, lo)] + [o[x:y] for o, x, y in zip(self.order, hi, b)]
            lo, hi = a, b
            hits += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((hits >= least) & ~done)
            if len(new):
                done[new] = True
                cosine[new] = self.unit[new] @ unit
                verified += len(new)
            everything = all(x == 0 and y == n for x, y in zip(lo, hi))
            if everything or radius >= 2.0 and verified >= k:
                break
            if verified >= k:
                kth = np.partition(cosine, n - k)[n - k]
                distance = sqrt(max(2.0 - 2.0 * kth, 0.0))
                if distance <= radius:
                    break
                radius = distance
            else:
                radius *= 2
        found = np.flatnonzero(cosine > -np.inf)
        if len(found) > k:
            kth = np.partition(cosine[found], len(found) - k)[len(found) - k]
            found = found[cosine[found] >= kth - 1e-9]
        exact = (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * norm)
        best = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found][best], exact[best], verified


def _usable(v: Column) -> Column:
    size = F.size(v)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (size > 0) & fine & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 64, least: int = 34, sure: float = 0.975, seed: int = 20,
            rows_per_shard: int = 65_536, least_rows: int = 8_192, least_shards: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, ``key``, score (cosine), verified: the k nearest found of each query row.

    ``least`` of ``m`` collisions make a vector a candidate. Shards hold ``rows_per_shard``
    rows at most; a small table is spread over ``least_shards``, of ``least_rows`` or more. Their
    number follows from the rows alone, so the cluster's size does not change what is found.
    """
    util.settle(vectors.sparkSession)
    if not isinstance(vectors.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be an integer column")
    value = F.col(vector).cast("array<double>")
    kept = vectors.select(F.col(key).cast("long").alias("id"), value.alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v"))).dropDuplicates(["id", "v"])
    equal = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    kept = kept.withColumn("_r", equal).filter(F.col("_r") <= k + 1).drop("_r")
    kept = util.staged(kept.withColumn("dim", F.size("v")), "vectors")
    asked = queries.select(F.col(key).cast("long").alias("id"), value.alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    rows = kept.count()
    shards = max(ceil(rows / rows_per_shard), min(least_shards, ceil(rows / least_rows)), 1)
    dims = kept.select("dim").distinct()
    shard = (F.shiftleft(F.col("dim").cast("long"), _DIM_SHIFT) + F.col("s"))
    left = kept.withColumn("s", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).select(shard.alias("shard"), F.lit(0).alias("asks"), "id", "v")
    each = asked.withColumn("dim", F.size("v")).join(dims, "dim").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = each.select(shard.alias("shard"), F.lit(1).alias("asks"), "id", "v")
    placed = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches):
        current, index, ids, rows_ = None, None, [], []
        for b in batches:
            shard_of, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy()
            change = np.flatnonzero((shard_of[1:] != shard_of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, len(shard_of)]):
                part = b.slice(int(lo), int(hi - lo))
                number = part.column("id").to_numpy()
                values = part.column("v").flatten().to_numpy().reshape(len(number), -1)
                if shard_of[lo] != current:
                    current, index, ids, rows_ = shard_of[lo], None, [], []
                if asks[lo] == 0:
                    ids.append(number)
                    rows_.append(values)
                    continue
                if index is None:
                    if not ids:
                        continue
                    index = Shard(np.concatenate(ids), np.concatenate(rows_), m, seed)
                    ids, rows_ = [], []
                out = [(int(q), *index.search(int(q), v, k, least, sure)) for q, v in zip(number, values)]
                size = [len(o[1]) for o in out]
                if sum(size):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat([o[0] for o in out], size), pa.int64()), pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                        pa.array(np.concatenate([o[2] for o in out])), pa.array(np.repeat([o[3] for o in out], size), pa.int64())],
                        ["query_id", "id", "score", "verified"])

    found = placed.mapInArrow(run, "query_id long, id long, score double, verified long").dropDuplicates(["query_id", "id", "score"])
    best = util.top_per_group(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score", "verified")
