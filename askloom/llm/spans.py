"""Words, lines and their hashes for a whole Arrow batch of texts at once.

All functions work on the UTF-8 bytes of a batch in numpy; no Python object is made per
word. A null text counts as empty. Hashes are 64-bit polynomials with fixed constants, so
they agree between tasks, retries and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = {_MULTIPLIER: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        grown = np.full(n + (n >> 2), base, np.uint64)
        grown[0] = 1
        _POWERS[base] = np.multiply.accumulate(grown)
    return _POWERS[base][:n]


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(column: pa.Array | pa.ChunkedArray, times: float = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, about ``times`` PIECE_BYTES at once."""
    raw, at = texts_of(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + int(times * PIECE_BYTES), side="right")) - 1)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text offsets of the maximal runs of ``inside``, cut at texts' ends."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[at] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without white space (space, tab to carriage return)."""
    return runs(~WHITE[raw], at)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * _powers(_MULTIPLIER, len(raw)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(raw) + 1)[starts])


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values (texts' ends are not looked at)."""
    out = np.zeros(max(len(values) - n + 1, 0), np.uint64)
    for j in range(n):
        out += values[j:j + len(out)] * _powers(_MULTIPLIER, n + 1)[n - j]
    return mixed(out)


def whole_grams(offsets: np.ndarray, n: int) -> np.ndarray:
    """Mask of the windows of ``n`` values that stay inside one text."""
    total = int(offsets[-1])
    keep = np.ones(max(total - n + 1, 0), bool)
    for j in range(1, n):
        edges = offsets[1:-1] - j
        keep[edges[(edges >= 0) & (edges < len(keep))]] = False
    short = np.diff(offsets) < n
    for i in np.flatnonzero(short):
        keep[offsets[i]:min(offsets[i + 1], len(keep))] = False
    return keep


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The text number of each value."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set positions in each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
