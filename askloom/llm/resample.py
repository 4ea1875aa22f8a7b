"""Draw documents that look like a target: importance weights over hashed n-grams, Gumbel top-k.

Features are runs of words, hashed into buckets. A bucket's gain compares its share of the
target with its share of the raw documents, a document's weight is the sum of the gains of
its features, and adding Gumbel noise from a hash of the key makes the highest scores a draw
without replacement in proportion to exp(weight / 1000).

Texts go through an open-addressed table in numpy, a piece of the Arrow batch at a time: the
64-bit xxhash of an n-gram gives its first slot, its bytes are compared with those of the
slot's owner, and on a mismatch it moves on to the next slot, so equal hashes of different
n-grams do not mix. A slot stores bucket and count. The first pass over the documents adds
up the slots' counts by bucket; the second gathers the buckets' gains by the slot of each
occurrence. Only the bucket counts (``buckets`` numbers, a parameter) reach the driver.

Defined results: a null or empty text has no features and weight 0. Rows are counted as they
come; rows of equal key, text and score are drawn in any order. A null key hashes like ''
and ranks first among equal scores. Only the key and the text are read, so no other column
can clash. With an empty target all its counts are 0; an empty table of documents gives no
rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import spans
from askloom.util import global_rank, settle, staged

_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = True
_WORD[ord("a"):ord("z") + 1] = True
_WORD[0x80:] = True

_U = np.uint64
# The five primes of the published 64-bit xxhash.
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxhash64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(xxhash64 with seed 0 of each byte span, the spans' first 32 bytes as four words).

    Spans under 32 bytes, nearly all, are hashed together; the library does the longer ones.
    """
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(32, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    lanes = np.zeros((4, len(starts)), _U)
    for j in range(4):
        has = np.flatnonzero(size > 8 * j)
        word = np.ascontiguousarray(eight[starts[has] + 8 * j]).view("<u8")[:, 0]
        left = np.minimum(size[has] - 8 * j, 8).astype(_U)
        lanes[j, has] = word & (~_U(0) >> (_U(64) - _U(8) * left))
    h = _P5 + size.astype(_U)
    for j in range(3):
        on = np.flatnonzero(size >= 8 * (j + 1))
        h[on] = _turned(h[on] ^ (_turned(lanes[j, on] * _P2, 31) * _P1), 27) * _P1 + _P4
    whole = np.minimum(size // 8, 3)
    rest = lanes[whole, np.arange(len(starts))]
    four = np.flatnonzero(size % 8 >= 4)
    h[four] = _turned(h[four] ^ ((rest[four] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    rest[four] >>= _U(32)
    for j in range(3):
        on = np.flatnonzero(size % 4 > j)
        h[on] = _turned(h[on] ^ (((rest[on] >> _U(8 * j)) & _U(0xFF)) * _P5), 11) * _P1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    h ^= h >> _U(32)
    data = raw.data
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    return h, lanes


class Table:
    """Open addressing over byte spans: a slot for each different span, by linear probing."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, hashed=xxhash64):
        n = len(starts)
        keys, lanes = hashed(raw, starts, ends)
        size = ends - starts
        mask = (1 << max(4, int(2 * n - 1).bit_length())) - 1  # at most half full
        owner = np.full(mask + 1, -1, np.int64)
        #: the slot of each occurrence
        self.slot = np.zeros(n, np.int64)
        waits, at = np.arange(n), (keys & _U(mask)).astype(np.int64)
        while len(waits):
            free = owner[at] < 0
            owner[at[free]] = waits[free]  # one of those that claim a slot gets it
            mine = owner[at]
            same = (keys[mine] == keys[waits]) & (size[mine] == size[waits]) & (lanes[:, mine] == lanes[:, waits]).all(axis=0)
            for i in np.flatnonzero(same & (size[waits] > 32)):
                a, b = mine[i], waits[i]
                same[i] = a == b or raw[starts[a]:ends[a]].tobytes() == raw[starts[b]:ends[b]].tobytes()
            self.slot[waits[same]] = at[same]
            waits, at = waits[~same], (at[~same] + 1) & mask
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        data, first = raw.data, owner[self.used]
        self.bucket[self.used] = [zlib.crc32(data[a:b]) % buckets for a, b in zip(starts[first].tolist(), ends[first].tolist())]


def _grams(raw: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, first of each text) of the runs of 1 to ``n`` words, length by length, words joined by one space."""
    raw = spans.LOWER[raw]
    starts, ends, first = spans.runs(_WORD[raw], at)
    size = ends - starts
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=begin[1:])
    even = np.full(int(begin[-1]), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    even[np.repeat(begin[:-1], size) + inner] = raw[np.repeat(starts, size) + inner]
    for k in range(1, n + 1):
        keep = spans.whole_grams(first, k)
        i = np.flatnonzero(keep)
        kept = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        yield even, begin[i], begin[i + k] - 1, kept[np.minimum(first, len(keep))]


def bucket_counts(texts: DataFrame, column: str, n: int, buckets: int) -> np.ndarray:
    """Occurrences of features in each bucket, over all rows. Tasks send at most one row per bucket."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, at in spans.pieces(batch.column(0)):
                for even, starts, ends, _ in _grams(raw, at, n):
                    t = Table(even, starts, ends, buckets)
                    np.add.at(total, t.bucket[t.used], t.count[t.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(column).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares, rounded down."""
    m = float(len(raw))
    top = (target + 1.0) * (float(raw.sum()) + m)
    below = (raw + 1.0) * (float(target.sum()) + m)
    return np.array([math.floor(1000.0 * math.log(x)) for x in top / below], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """(key, n_words, n_features, weight) of every row; the gains travel to the documents."""
    buckets = len(gain)
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for lo, hi, raw, at in spans.pieces(batch.column(1)):
                words = features = weight = np.zeros(hi - lo, np.int64)
                for k, (even, starts, ends, first) in enumerate(_grams(raw, at, n)):
                    t = Table(even, starts, ends, buckets)
                    run_up = np.zeros(len(starts) + 1, np.int64)
                    np.cumsum(gain[t.bucket[t.slot]], out=run_up[1:])
                    weight = weight + run_up[first[1:]] - run_up[first[:-1]]
                    features = features + np.diff(first)
                    words = np.diff(first) if k == 0 else words
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (words, features, weight))], ["k", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("k", key)


def gumbel(key, seed: int):
    """1000 times a standard Gumbel draw that follows from the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1,
         buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row.

    Of the rows with at least ``least_words`` words the ``percent`` with the highest scores
    are drawn and ranked, ties to the smaller key; the other ranks are null. Scores are
    written once; ranks come from range partitions, so no task sorts all documents.
    """
    settle(docs.sparkSession)
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    rows = weights(docs, gain, key, text, n).withColumn("score", F.col("weight") + gumbel(F.col(key), seed))
    rows = staged(rows, "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    ranked = global_rank(rows.filter(able), [-F.col("score"), F.col(key)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint"))
    return ranked.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))
