"""The interning table against a dict, its hash against the library, and the draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from askloom.llm import resample


def spans_of(items):
    raw = np.frombuffer(b"".join(items), np.uint8)
    ends = np.cumsum([len(x) for x in items]).astype(np.int64)
    return raw, ends - [len(x) for x in items], ends


def test_hash_equals_library():
    r = random.Random(1)
    items = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(100), *range(40)] * 3]
    raw, starts, ends = spans_of(items)
    assert resample.xxhash64(raw, starts, ends)[0].tolist() == [xxhash.xxh64_intdigest(x) for x in items]


@pytest.mark.parametrize("keys", [None, 1, 3])
def test_table(keys):
    """Slots stand for different byte strings, also where hashes are made to collide."""
    r = random.Random(2)
    items = [bytes(r.choice(b"ab") for _ in range(r.choice([1, 2, 5, 31, 32, 33, 40]))) for _ in range(3000)]
    items += [b"x" * 40 + b"1", b"x" * 40 + b"2"] * 5
    raw, starts, ends = spans_of(items)

    def few(*a):
        h, lanes = resample.xxhash64(*a)
        return h % np.uint64(keys), lanes

    t = resample.Table(raw, starts, ends, 97, few if keys else resample.xxhash64)
    slots = {}
    for x, s in zip(items, t.slot.tolist()):
        assert slots.setdefault(x, s) == s
    assert len(set(slots.values())) == len(slots) == len(t.used)
    for x, n in Counter(items).items():
        assert t.count[slots[x]] == n and t.bucket[slots[x]] == zlib.crc32(x) % 97
    assert len(resample.Table(raw[:0], starts[:0], ends[:0], 5).used) == 0


def features(text, n):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n, m, percent, least, seed):
    def counted(texts):
        c = Counter(zlib.crc32(f.encode()) % m for t in texts for f in features(t, n)[1])
        return c, sum(c.values())

    (s, S), (t, T) = counted([x for _, x in rows]), counted(target)
    out = []
    for key, text in rows:
        words, fs = features(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + float(m)) / ((s[b] + 1.0) * (T + float(m))))) for b in (zlib.crc32(f.encode()) % m for f in fs))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    rank = {id(x): i for i, x in enumerate(able[:percent * len(able) // 100], 1)}
    return [(*x, rank.get(id(x))) for x in out]


@pytest.mark.parametrize("n,m,percent", [(1, 10_000, 10), (3, 50, 60), (2, 1, 100)])
def test_equals_plain_version(spark, n, m, percent):
    r = random.Random(4)
    words = ["The", "model", "trains", "x1", "naïve", "日本語", "of", "a", "long-word", "supercalifragilisticexpialidocious", "7"]
    text = lambda k: "".join(r.choice(words[: 3 + k % 9]) + r.choice([" ", "  ", "\n", ", "]) for _ in range(r.randint(0, 40)))
    rows = [(k, text(k)) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "?!"), (403, "w" * 100_000), (404, "a b " * 30_000), (None, text(5) * 3), (405, rows[7][1]), (401, "")]
    target = [text(1) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "clash", 0, 1) for k, t in rows], "doc_id long, text string, k string, score int, bucket int").repartition(3)
    got = resample.draw(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=m, percent=percent, least_words=5).collect()
    want = brute(rows, target, n, m, percent, 5, 2024)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[5] is not None for w in want) == percent * sum(w[1] >= 5 for w in want) // 100


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert resample.draw(docs.filter("false"), docs).count() == 0
    got = {r.doc_id: r for r in resample.draw(docs, docs.select("text").filter("false"), percent=50).collect()}
    assert sorted(r.rank or 0 for r in got.values()) == [0, 1] and all(r.weight < 0 for r in got.values())
