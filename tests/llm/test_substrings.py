"""Removed words against plain Python, with hot passages, borders, repeated and odd rows."""

import hashlib
import random
import re

from askloom.llm import substrings


def brute(rows, n=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words):
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            least[g] = min(least.get(g, k), k)
    out = []
    for (k, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i:i + n])] < k:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"é{i}" if i % 9 == 0 else f"w{i}" for i in range(400)] + ["a"] * 60
    pick = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [pick(r.randint(12, 40)) for _ in range(6)] + [["a"] * 30]
    rows = []
    for k in range(150):
        parts = [pick(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages[:2] if r.random() < 0.6 else passages)
            cut = r.randint(0, 4)
            parts += [p[cut:] if r.random() < 0.4 else p, pick(r.randint(0, 20))]
        rows.append((k * 3 - 50, r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, rows[0][1]), (903, rows[0][1]), (903, rows[1][1]), (904, "b " * 13), (905, "b " * 14)]
    r.shuffle(rows)
    return rows


def test_against_all_windows(spark, monkeypatch):
    for seed, gathered in ((1, 2_000_000), (2, 500)):
        monkeypatch.setattr(substrings, "_GATHERED", gathered)
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(tuple(r) for r in substrings.without_repeats(df).collect())
        assert got == brute(rows)


def test_odd_tables(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = spark.createDataFrame([(1, long, "q", 1), (2, long, "q", 1), (None, long, None, None)], "doc_id long, text string, k string, t int")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(rows).collect()}
    assert got == {1: (60_000, 0), 2: (60_000, 60_000), None: (60_000, 0)}
    assert substrings.without_repeats(rows.limit(0)).count() == 0
