"""Repeated word windows across documents, removed exactly from all but the smallest document.

A window is ``n`` consecutive words. A word goes if a window covers it whose word sequence
also starts in a document of smaller key. Three jobs, each with one shuffle that a frequent
passage cannot overload:

1. Anchors. Of the k-word grams in each window the one of smallest hash is its anchor, so
   equal windows have equal anchors (about one in five positions is one). A task sends each
   anchor on once, whatever the number of its documents that hold it; anchors that two of its
   own documents share are settled on the spot. The buckets of the shuffle say which of the
   others are shared.
2. Windows. Only windows whose anchor is shared are hashed. A task sends each window for its
   smallest document only; its other documents are settled on the spot. The buckets hand back
   what is not the smallest document of all.
3. The covered words are cut out.

Anchors and windows travel as lists of numbers, many to a row, in buckets whose number grows
with the table. A hot passage costs one entry per task and bucket, never one per document.

Suffix automata of all documents as reference, broadcast to every task, would grow with the
corpus on each machine, and every document would have to be read against every shard;
The README has the figures.

Defined results: a null or empty text has no words; texts of fewer than ``n`` words keep all;
rows of equal key are never smaller than each other; rows of null key are kept whole and
are nobody's reference. Keys are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom import util
from askloom.llm import spans

GRAM = 5
#: entries that a task gathers before it sends them, and bytes of text per bucket
_GATHERED = 2_000_000
_BUCKET_BYTES = 16 << 20


def windows_of(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, offsets, window starts, anchor hash of each window)."""
    starts, ends, offsets = spans.words(raw, at)
    word = spans.hashes(raw, starts, ends)
    begin = np.flatnonzero(spans.whole_grams(offsets, n))
    if not len(begin):
        return word, offsets, begin, np.zeros(0, np.uint64)
    gram = spans.grams(word, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(gram, n - GRAM + 1).min(axis=1)
    return word, offsets, begin, least[begin]


def _lists(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """One row per bucket: the bucket numbers, and each column as lists."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    cut = pa.array(np.append(first, len(bucket)), pa.int32())
    return found, [pa.ListArray.from_arrays(cut, pa.array(c[order])) for c in columns]


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal sorted values, and the run of each value."""
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    return np.flatnonzero(head), np.cumsum(head) - 1


def _buckets(docs: DataFrame) -> int:
    size = util.planned_bytes(docs) or 0
    return max(12, size // _BUCKET_BYTES)


def _shared_anchors(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(k, anchors): for each document the anchors that another document has too."""
    def send(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush():
            anchor = np.concatenate([x[0] for x in held])
            doc = np.concatenate([x[1] for x in held])
            order = np.lexsort((doc, anchor))
            sorted_, owner = anchor[order], doc[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (sorted_[1:] != sorted_[:-1]) | (owner[1:] != owner[:-1])
            order = order[fresh]
            first, run = _groups(anchor[order])
            several = np.diff(np.append(first, len(order)))[run] > 1
            open_ = np.arange(len(order)) - first[run] < 2  # of several documents two tell the bucket that the anchor is shared
            for settled, mask in ((False, open_), (True, several & ~open_)):
                part = np.sort(order[mask])  # as they stand in the documents: equal keys in a row are small when packed
                if len(part):
                    bucket = (spans.mixed(doc[part].view(np.uint64)) if settled else anchor[part]) % np.uint64(buckets)
                    number, (a, d) = _lists(bucket.astype(np.int32), [anchor[part].view(np.int64), doc[part]])
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.full(len(number), settled)), a, d], ["bucket", "settled", "a", "d"])

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, raw, at in spans.pieces(b.column(1)):
                _, offsets, begin, anchor = windows_of(raw, at, n)
                row = np.searchsorted(offsets, begin, side="right") - 1
                change = np.ones(len(anchor), bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                held.append((anchor[change], keys[lo:hi][row[change]].astype(np.int64)))
                count += int(change.sum())
                if count >= _GATHERED:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        known = table.filter(table.column("settled"))
        rest = table.filter(pa.compute.invert(table.column("settled")))
        anchor, doc = _flat(rest.column("a")), _flat(rest.column("d"))
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        first, run = _groups(anchor)
        if len(anchor):
            keep = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))[run]
            anchor, doc = anchor[keep], doc[keep]
        anchor, doc = np.concatenate([anchor, _flat(known.column("a"))]), np.concatenate([doc, _flat(known.column("d"))])
        number, (a,) = _lists(doc.astype(np.int64), [anchor.astype(np.int64)]) if len(doc) else (np.zeros(0, np.int64), [pa.array([], pa.list_(pa.int64()))])
        return pa.table([pa.array(number, pa.int64()), a], ["k", "a"])

    sent = docs.select("k", "x").mapInArrow(send, "bucket int, settled boolean, a array<long>, d array<long>")
    told = sent.groupBy("bucket").applyInArrow(settle, "k long, a array<long>")
    return told.groupBy("k").agg(F.flatten(F.collect_list("a")).alias("anchors"))


def _covered(docs: DataFrame, anchors: DataFrame, n: int, buckets: int) -> DataFrame:
    """(k, t, starts): windows of each document that a document of smaller key has too."""
    def send(batches):
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush():
            window, doc, t, pos = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, window))
            first, run = _groups(window[order])
            least = doc[order] == doc[order][first][run]
            for settled, mask in ((False, least), (True, ~least)):
                part = np.sort(order[mask])
                if len(part):
                    bucket = (spans.mixed(doc[part].view(np.uint64)) if settled else window[part]) % np.uint64(buckets)
                    columns = [np.zeros(len(part), np.int64) if settled else window[part].view(np.int64), doc[part], t[part], pos[part]]
                    number, lists = _lists(bucket.astype(np.int32), columns)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.full(len(number), settled)), *lists], ["bucket", "settled", "w", "d", "t", "p"])

        for b in batches:
            keys = b.column("k").to_numpy(zero_copy_only=False)
            marks = b.column("t").to_numpy(zero_copy_only=False)
            lists = b.column("anchors")
            for lo, hi, raw, at in spans.pieces(b.column("x")):
                word, offsets, begin, anchor = windows_of(raw, at, n)
                mine = lists.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), np.diff(mine.offsets.to_numpy()))
                wanted = np.unique(spans.mixed(mine.flatten().to_numpy().view(np.uint64)) ^ spans.mixed(owner.astype(np.uint64)))
                row = np.searchsorted(offsets, begin, side="right") - 1
                key = spans.mixed(anchor) ^ spans.mixed(row.astype(np.uint64))
                if not len(wanted) or not len(key):
                    continue
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                begin, row = begin[hit], row[hit]
                held.append((spans.grams(word, n)[begin], keys[lo:hi][row].astype(np.int64), marks[lo:hi][row].astype(np.int32), (begin - offsets[row]).astype(np.int32)))
                count += len(begin)
                if count >= _GATHERED:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        known = table.filter(table.column("settled"))
        rest = table.filter(pa.compute.invert(table.column("settled")))
        window, doc, t, pos = (_flat(rest.column(c)) for c in "wdtp")
        order = np.argsort(window, kind="stable")
        window, doc, t, pos = window[order], doc[order], t[order], pos[order]
        first, run = _groups(window)
        if len(window):
            keep = doc > np.minimum.reduceat(doc, first)[run]
            doc, t, pos = doc[keep], t[keep], pos[keep]
        doc, t, pos = (np.concatenate([x, _flat(known.column(c))]) for x, c in zip((doc, t, pos), "dtp"))
        order = np.lexsort((pos, t, doc))
        doc, t, pos = doc[order].astype(np.int64), t[order].astype(np.int32), pos[order].astype(np.int32)
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
        first = np.flatnonzero(head)
        cut = pa.array(np.append(first, len(doc)), pa.int32())
        return pa.table([pa.array(doc[first]), pa.array(t[first]), pa.ListArray.from_arrays(cut, pa.array(pos))], ["k", "t", "p"])

    found = docs.join(anchors, "k").select("k", "t", "x", "anchors")
    sent = found.mapInArrow(send, "bucket int, settled boolean, w array<long>, d array<long>, t array<int>, p array<int>")
    told = sent.groupBy("bucket").applyInArrow(settle, "k long, t int, p array<int>")
    return told.groupBy("k", "t").agg(F.flatten(F.collect_list("p")).alias("starts"))


def without_repeats(docs: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256 of the kept words, and their text."""
    util.settle(docs.sparkSession)
    buckets = _buckets(docs)
    mark = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    whole = docs.select(F.col(key).cast("long").alias("k"), mark.alias("t"), F.col(text).alias("x"))
    known = whole.filter(F.col("k").isNotNull() & F.col("x").isNotNull())
    anchors = _shared_anchors(known, n, buckets)
    covered = _covered(known, anchors, n, buckets)
    joined = whole.join(covered, ["k", "t"], "left").select("k", "x", "starts")

    def cut(batches):
        for b in batches:
            lists = b.column("starts")
            for lo, hi, raw, at in spans.pieces(b.column("x")):
                starts, ends, offsets = spans.words(raw, at)
                gone = np.zeros(len(starts) + 1, np.int64)
                mine = lists.slice(lo, hi - lo)
                size = pa.compute.fill_null(pa.compute.list_value_length(mine), 0).to_numpy(zero_copy_only=False)
                place = mine.flatten().to_numpy() + np.repeat(offsets[:-1], size)
                np.add.at(gone, place, 1)
                np.add.at(gone, np.minimum(place + n, len(starts)), -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = _joined_words(raw, starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])
                n_words, left = np.diff(offsets), spans.counts(keep, offsets)
                columns = [b.column("k").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_words - left, pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["k", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    columns.append(pa.array([x.decode() for x in kept], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "k long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts
    return joined.mapInArrow(cut, schema).withColumnRenamed("k", key)


def _joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The given words of each text joined by single blanks."""
    size = ends - starts
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=begin[1:])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin[:-1], size) + inner] = raw[np.repeat(starts, size) + inner]
    data, cut = out.tobytes(), begin[offsets].tolist()
    return [data[a:max(a, z - 1)] for a, z in zip(cut, cut[1:])]
