"""Byte-level BPE encoding and decoding by numpy merge rounds.

Texts are cut into words as the vocabulary's splitting pattern does, equal words of a piece
of text are encoded once, and all their symbols lie in one flat array. A round looks up the
rank of every changed pair by binary search over the sorted pair keys, finds the lowest rank
of each word and merges its places; words without a known pair leave the array. A merged
pair only ever forms pairs of higher rank, so merging all places of the lowest pair at once
gives what one merge at a time gives.

Null and empty texts have no ids. Texts of any length are read whole; words longer than
``LONG_WORD`` symbols are merged with a heap, with equal results, as rounds would take a
quadratic time there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from askloom.llm import spans

LONG_WORD = 256
#: pieces of texts that are encoded at once, in spans.PIECE_BYTES; larger ones need more memory and are no faster
PIECE = 0.5
_NO_RANK = np.int32(1 << 30)
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
# Unicode white space, and the endings that the splitting pattern keeps with their apostrophe.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for run in regex.findall(pattern, known):
            table[[ord(c) for c in run]] = kind
    table[_WHITE_SPACE] = _SPACE
    # where the two Unicode versions at hand differ, the library's own splitter says what it takes
    splits = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in map(ord, known):
        if {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) != table[c] != _SPACE:
            table[c] = next((kind for kind, sign in ((_LETTER, "a"), (_NUMBER, "1")) if len(splits(sign + chr(c))) == 1), _OTHER)
    return table


def split_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions at which a word of the splitting pattern begins."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[first]
    n = len(first)
    if n == 0:
        return first
    point = lead.astype(np.int32)
    for low, high, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        wide = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[wide].astype(np.int32) & bits
        for j in range(1, size):
            value = (value << 6) | (raw[first[wide] + j] & 0x3F)
        point[wide] = value
    kind = _classes()[point]
    head = np.zeros(n + 1, bool)  # first characters of texts, and the end
    head[np.searchsorted(first, at)] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= head[:-1]
    space = kind == _SPACE
    blank = point == 0x20
    # a run of white space gives its last character to itself, or to the word after it if it is a blank
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:-1]
    starts = change | last
    joined = np.flatnonzero(last & blank) + 1
    starts[joined] = False
    # apostrophe and ending, where the apostrophe begins a word and is all of its run
    quote = np.flatnonzero((point == 0x27) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~head[quote + 1]]
    for ending in _ENDINGS:
        q = quote[quote + len(ending) < n]
        for j, c in enumerate(ending, 1):
            q = q[(point[q + j] == ord(c)) & ~head[q + j]]
        starts[q + 1] = False
        after = q + 1 + len(ending)
        starts[after[after < n]] |= kind[after[after < n]] == _LETTER
    return first[starts]


class Vocabulary:
    """Pair keys, ranks and byte strings of a byte-level BPE vocabulary file (its content)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        ids = spec["model"]["vocab"]
        chars = {c: b for b, c in enumerate(_byte_chars())}
        size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(chars[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token
        self.byte_ids = np.array([ids[c] for c in _byte_chars()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.keys, self.key_ranks = key[order], order.astype(np.int32)
        self.made = made
        self.text_of = [str(i) for i in range(size)]
        each = np.arange(256)
        self.first_ranks = self.ranks(self.byte_ids[np.repeat(each, 256)], self.byte_ids[np.tile(each, 256)])
        self.pair_ranks = dict(zip(key.tolist(), range(len(key))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], _NO_RANK)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(2)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def merge_words(v: Vocabulary, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of words given as byte values."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    done_word, done_ids = [], []
    ids = v.byte_ids[symbols]
    first = np.full(len(ids), _NO_RANK)  # ranks of the pairs of bytes, searched once per vocabulary
    first[:-1] = v.first_ranks[symbols[:-1].astype(np.int32) * 256 + symbols[1:]]
    for i in np.flatnonzero(size > LONG_WORD):
        long = _merge_long(v, ids[offsets[i]:offsets[i + 1]].tolist())
        done_word.append(np.full(len(long), i))
        done_ids.append(np.array(long, np.int32))
    word = np.repeat(np.arange(n), size)
    if (size > LONG_WORD).any():
        keep = (size <= LONG_WORD)[word]
        ids, word, first = ids[keep], word[keep], first[keep]
    rank = first
    rank[:-1][word[1:] != word[:-1]] = _NO_RANK
    rank[-1:] = _NO_RANK
    while len(ids):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(ids)))
        live = lowest < _NO_RANK
        each = np.repeat(live, lengths)
        if not live.all():
            done_word.append(word[~each])
            done_ids.append(ids[~each])
            ids, word, rank = ids[each], word[each], rank[each]
            lowest, lengths = lowest[live], lengths[live]
            if not len(ids):
                break
        hit = rank == np.repeat(lowest, lengths)
        place = np.flatnonzero(hit)
        # of overlapping places of a pair of equal symbols, every second one counts
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1] + 1) | (word[place[1:]] != word[place[:-1]])
        if not fresh.all():
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
        ids[place] = v.made[rank[place]]
        stay = np.ones(len(ids), bool)
        stay[place + 1] = False
        fixed = np.zeros(len(ids), bool)
        fixed[place] = True
        ids, word, rank, fixed = ids[stay], word[stay], rank[stay], fixed[stay]
        fixed[:-1] |= fixed[1:]
        now = np.flatnonzero(fixed)
        rank[now] = _NO_RANK
        now = now[now + 1 < len(ids)]
        now = now[word[now] == word[now + 1]]
        rank[now] = v.ranks(ids[now], ids[now + 1])
    if not done_word:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    word, ids = np.concatenate(done_word), np.concatenate(done_ids)
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(word, minlength=n), out=out[1:])
    return ids[np.argsort(word, kind="stable")], out


def _merge_long(v: Vocabulary, ids: list[int]) -> list[int]:
    """One long word: a heap of (rank, place) over a linked list of symbols."""
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := v.pair_ranks.get((ids[i] << 32) | ids[j])) is not None:
            heap.append((r, i, ids[i], ids[j]))

    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = int(v.made[r]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0 and after[k] >= 0 and (r := v.pair_ranks.get((ids[k] << 32) | ids[after[k]])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
    return [x for x in ids if x >= 0]


def _with_specials(raw: np.ndarray, at: np.ndarray, special: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(start, end, id) of every special token's string that lies in one text."""
    found, text = [], None
    for token, i in special.items():
        text = raw.tobytes() if text is None else text
        p = text.find(token)
        while p >= 0:
            row = int(np.searchsorted(at, p, side="right")) - 1
            if p + len(token) <= at[row + 1]:
                found.append((p, p + len(token), i))
                p = text.find(token, p + len(token))
            else:
                p = text.find(token, p + 1)
    return sorted(found)


class Encoded:
    """A piece of texts: the distinct words' ids, and each text's words by number."""

    def __init__(self, v: Vocabulary, raw: np.ndarray, at: np.ndarray):
        specials = _with_specials(raw, at, v.special)
        cuts = np.unique(np.array([0, *(x for s in specials for x in s[:2])], np.int64)) if specials else None
        starts = split_points(raw, at if cuts is None else np.unique(np.concatenate([at, cuts])))
        if specials:  # inside a special token no word begins
            inside = np.zeros(len(raw) + 1, bool)
            for lo, hi, _ in specials:
                inside[lo + 1:hi] = True
            starts = starts[~inside[starts]]
        ends = np.append(starts[1:], len(raw))
        key = spans.hashes(raw, starts, ends)
        self.word, _ = pd.factorize(key)  # numbers in order of appearance
        first = np.flatnonzero(np.diff(np.maximum.accumulate(self.word), prepend=-1))
        size = (ends - starts)[first]
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        source = np.repeat(starts[first] - offsets[:-1], size) + np.arange(offsets[-1])
        self.ids, self.offsets = merge_words(v, raw[source], offsets)
        self.text_words = np.searchsorted(starts, at)
        if specials:
            self._place(dict((lo, i) for lo, _, i in specials), starts[first])

    def _place(self, special: dict[int, int], first: np.ndarray) -> None:
        """Give the words that are special tokens their one id."""
        replaced = [(w, special[int(p)]) for w, p in enumerate(first) if int(p) in special]
        parts = [self.ids[self.offsets[w]:self.offsets[w + 1]] for w in range(len(first))]
        for w, i in replaced:
            parts[w] = np.array([i], np.int32)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.ids = np.concatenate(parts)

    def text_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's offsets in them."""
        size = np.diff(self.offsets)[self.word]
        end = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=end[1:])
        source = np.repeat(self.offsets[:-1][self.word] - end[:-1], size) + np.arange(end[-1])
        return self.ids[source], end[self.text_words]

    def rows(self, make) -> list[list]:
        """For each text, ``make(ids of a word)`` of all its words; made once for each word."""
        cut, ids = self.offsets.tolist(), self.ids.tolist()
        made = [make(ids[a:b]) for a, b in zip(cut, cut[1:])]
        numbers, at = self.word.tolist(), self.text_words.tolist()
        return [[made[w] for w in numbers[a:b]] for a, b in zip(at, at[1:])]


def encode_pieces(content: bytes, column: pa.Array) -> Iterator[tuple[int, int, Encoded]]:
    v = _vocabulary(content)
    for lo, hi, raw, at in spans.pieces(column, PIECE):
        yield lo, hi, Encoded(v, raw, at)


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file as bytes, read where the driver runs and sent to the tasks (1.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of whole texts; a special token's string becomes its id."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        for b in batches:
            for lo, hi, e in encode_pieces(content.value, b.column(1)):
                ids, at = e.text_ids()
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of id arrays; bytes that are no UTF-8 become the replacement character.

    A null array gives an empty text; ids outside the vocabulary are an error.
    """
    content = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        table = _vocabulary(content.value).bytes_of
        for b in batches:
            out = [b"".join([table[i] for i in row or ()]).decode("utf-8", "replace") for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(encoded[key].alias("k"), encoded[ids].alias("ids")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and of the text decoded from them, in one pass.

    Columns: key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.
    Equal words share their ids' strings and their decoded bytes.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        v = _vocabulary(content.value)
        for b in batches:
            for lo, hi, e in encode_pieces(content.value, b.column(1)):
                named, decoded = [], []
                for row in e.rows(lambda ids: (",".join([v.text_of[i] for i in ids]), b"".join([v.bytes_of[i] for i in ids]))):
                    named.append(hashlib.sha256(",".join([x[0] for x in row]).encode()).hexdigest())
                    said = b"".join([x[1] for x in row]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(said.encode()).hexdigest())
                size = np.add.reduceat(np.append(np.diff(e.offsets)[e.word], 0), e.text_words[:-1]) * (np.diff(e.text_words) > 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(named), pa.array(decoded)],
                    ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
