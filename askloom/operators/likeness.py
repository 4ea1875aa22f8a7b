"""Pairs of like strings between two blocks of strings, in numpy: bounds of difflib's ratio that lose no pair.

A ratio counts characters in common blocks, which are a common subsequence; so it is at most
2 x shared characters / both lengths, and at most the same with the longest common
subsequence. The first bound is taken for all pairs of two blocks, the second for those that
it leaves. Characters are folded to 64 letters, which can only raise both bounds.
"""

from __future__ import annotations

import numpy as np

LETTERS = 64
#: words of 64 bits up to which subsequences of many pairs are counted at once; longer strings are counted pair by pair
WIDE = 64
_LOW = np.array([(1 << i) - 1 for i in range(65)], dtype=np.uint64)
_ONES = np.uint64(2**64 - 1)


class Block:
    """Strings as rows of letters, in order of their length; the letter after the last one fills up."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(t) for t in texts], dtype=np.int64)
        longest = int(self.n.max(initial=0))
        code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        self.rows = np.full((len(texts), longest), LETTERS, dtype=np.uint8)
        self.rows[np.arange(longest) < self.n[:, None]] = ((code & 31) + 21 * (code >> 5)) % LETTERS
        counts = np.min_scalar_type(longest)
        self.bags = np.array([np.count_nonzero(self.rows == c, axis=1) for c in range(LETTERS)], dtype=counts)
        self.words = -(-longest // 64)
        self._masks = None

    def masks(self) -> list[np.ndarray]:
        """Of each word of 64 places, the places of each letter in each row, at letter x rows + row."""
        if self._masks is None:
            size = len(self.rows)
            self._masks = [np.zeros((LETTERS + 1) * size, dtype=np.uint64) for _ in range(self.words)]
            for w, out in enumerate(self._masks):
                part = np.full((size, 64), LETTERS, dtype=np.uint8)
                cut = self.rows[:, 64 * w:64 * (w + 1)]
                part[:, :cut.shape[1]] = cut
                for c in range(LETTERS):
                    out[c * size:(c + 1) * size] = np.packbits(part == c, axis=1, bitorder="little").view("<u8")[:, 0]
        return self._masks


def _ratio(matched, length):
    return 2.0 * matched / length  # as difflib computes it


def _shared(a: Block, b: Block, same: bool, threshold: float, high: int = 256, wide: int = 2048):
    """(x, y) of the pairs that share letters enough, for one strip of rows of ``a`` after the other."""
    used = np.flatnonzero(a.bags.any(axis=1) & b.bags.any(axis=1))
    half = threshold / 2 * (1 - 1e-5)  # the exact test comes later
    for i in range(0, len(a.n), high):
        na = a.n[i:i + high]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for j in range(i // wide * wide if same else 0, len(b.n), wide):
            nb = b.n[j:j + wide]
            if _ratio(na[-1], na[-1] + nb[0]) <= threshold and na[-1] <= nb[0]:
                break
            sums = np.zeros((len(na), len(nb)), dtype=np.promote_types(a.bags.dtype, b.bags.dtype))
            for c in used:
                sums += np.minimum(a.bags[c, i:i + high, None], b.bags[c, None, j:j + wide])
            x, y = np.nonzero(sums > np.float32(half) * na[:, None].astype(np.float32) + np.float32(half) * nb[None, :].astype(np.float32))
            x, y = x + i, y + j
            found.append((x[x < y], y[x < y]) if same else (x, y))
        yield tuple(np.concatenate(z) for z in zip(*found))


def _alike(a: Block, b: Block, x: np.ndarray, y: np.ndarray, threshold: float, every: int = 16) -> np.ndarray:
    """Which pairs have a common subsequence long enough: bit-parallel over the places of ``b``, all pairs at once.

    A cleared bit is a place where the longest common subsequence grows. After i letters of
    one string, what the rest can add is known, and hopeless pairs are left out.
    """
    masks, size, words = b.masks(), len(b.rows), b.words
    left, letters = np.arange(len(x)), np.ascontiguousarray(a.rows[x].T)
    n1, n2, y = a.n[x], b.n[y], y.astype(np.intp)
    v = [np.full(len(x), _ONES) for _ in range(words)]
    steps = letters.shape[0]
    for i in range(steps):
        at, carry = letters[i].astype(np.intp) * size + y, None
        for w in range(words):
            u = v[w] & masks[w].take(at)
            s = v[w] + u
            over = s < u
            if carry is not None:
                s += carry
                over |= s < carry
            v[w] = s | (v[w] ^ u)
            carry = over.astype(np.uint64)
        if i % every == every - 1 or i == steps - 1:
            done = np.minimum(i + 1, n1)
            upto = np.clip(done + n2 - n1, 0, n2)
            most = np.minimum(n1 - done, n2 - upto)
            for w in range(words):
                bits = np.clip(upto - 64 * w, 0, 64)
                most += bits - np.bitwise_count(v[w] & _LOW[bits])
            ok = _ratio(most, n1 + n2) > threshold
            if not ok.all():
                left, letters, n1, n2, y = left[ok], letters[:, ok], n1[ok], n2[ok], y[ok]
                v = [z[ok] for z in v]
                if not len(left):
                    break
    return left


def _alike_long(a: Block, b: Block, x: int, y: int, threshold: float) -> bool:
    """``_alike`` of one pair of long strings, on whole numbers of any length."""
    row, n2 = b.rows[y, :b.n[y]], int(b.n[y])
    places = {int(c): int.from_bytes(np.packbits(row == c, bitorder="little").tobytes(), "little") for c in np.unique(row)}
    n1, full = int(a.n[x]), (1 << n2) - 1
    v, check = full, max(16, n1 // 16)
    for i, c in enumerate(a.rows[x, :n1].tolist(), 1):
        u = v & places.get(c, 0)
        v = ((v + u) | (v ^ u)) & full
        if i % check == 0 or i == n1:
            upto = min(max(i + n2 - n1, 0), n2)
            most = upto - (v & ((1 << upto) - 1)).bit_count() + min(n1 - i, n2 - upto)
            if _ratio(most, n1 + n2) <= threshold:
                return False
    return True


def like_pairs(a: list[str], b: list[str] | None, threshold: float, batch: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): rows of ``a`` and ``b``, or earlier and later rows of ``a`` if there is no ``b``, that can have a ratio above ``threshold``.

    No string is empty; each list is in order of length, and ``b`` holds none shorter than those of ``a``.
    """
    left = Block(a)
    right = left if b is None else Block(b)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for x, y in _shared(left, right, b is None, threshold):
        for k in range(0, len(x), batch):
            xs, ys = x[k:k + batch], y[k:k + batch]
            if right.words <= WIDE:
                ok = _alike(left, right, xs, ys, threshold)
            else:
                ok = np.array([i for i, (p, q) in enumerate(zip(xs, ys)) if _alike_long(left, right, p, q, threshold)], dtype=np.int64)
            found.append((xs[ok], ys[ok]))
    return tuple(np.concatenate(z) for z in zip(*found))
