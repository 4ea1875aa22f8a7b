"""Sets of word shingles of a batch of texts, as 64-bit hashes in numpy; no Python object is made per word."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: bytes of text that are worked on at once; a longer text is a piece of its own
PIECE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_HOT = np.uint64(1 << 63)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _joined(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values, below 2**63."""
    out = np.zeros(max(len(values) - n + 1, 0), np.uint64)
    for j in range(n):
        out += values[j:j + len(out)] * np.uint64(pow(_MULTIPLIER, n - j, 1 << 64))
    return mixed(out + np.uint64(n)) >> np.uint64(1)


def sets_of(texts: pa.Array, n: int, hot: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text in one common order: by hash, those of ``hot`` (sorted) last and marked.

    A text with fewer than ``n`` words is one shingle of all its words.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw, at = np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]
    inside = ~WHITE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | cut[1:])) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_MULTIPLIER, len(raw)), out=total[1:])
    word = mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(raw) + 1)[starts])
    all_ = marked(_joined(word, n), hot)
    out, first = [], np.searchsorted(starts, at).tolist()
    for a, b in zip(first, first[1:]):
        s = np.sort(all_[a:b - n + 1]) if b - a >= n else marked(_joined(word[a:b], b - a), hot)[:b > a]
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
    return out


def marked(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if len(hot) == 0 or len(values) == 0:
        return values
    frequent = hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values
    return values | np.where(frequent, _HOT, np.uint64(0))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat.view(np.int64)))


def _pieces(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """Rows of a batch, the text in its second column, about PIECE_BYTES at once."""
    lengths = batch.column(1).cast(pa.large_string())
    at = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:lengths.offset + len(lengths) + 1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE_BYTES, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def prefix_length(n: int, threshold: float) -> int:
    """Two sets of a Jaccard similarity of ``threshold`` meet among so many first members of a common order."""
    return max(1, n - int(np.ceil(threshold * n - 1e-9)) + 1)


def described(batches: Iterable[pa.RecordBatch], n: int, threshold: float, hot: np.ndarray) -> Iterable[pa.RecordBatch]:
    """(key, n, s1, s2, prefix) of (key, text): size of the set, 128 bits that name it, its first members in the common order."""
    for batch in batches:
        for part in _pieces(batch):
            sets = sets_of(part.column(1), n, hot)
            plain = [s & ~_HOT for s in sets]
            name = [np.array([np.sum(mixed(s + np.uint64(k)), dtype=np.uint64) for s in plain], np.uint64).view(np.int64) for k in (1, 0x5851F42D4C957F2D)]
            size = np.array([len(s) for s in sets], np.int64)
            prefix = _lists([s[:prefix_length(len(s), threshold)] for s in sets])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(name[0]), pa.array(name[1]), prefix], ["key", "n", "s1", "s2", "prefix"])


def whole(batches: Iterable[pa.RecordBatch], n: int) -> Iterable[pa.RecordBatch]:
    """(node, shingles) of (key, text)."""
    for batch in batches:
        for part in _pieces(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets_of(part.column(1), n, np.zeros(0, np.uint64)))], ["node", "shingles"])
