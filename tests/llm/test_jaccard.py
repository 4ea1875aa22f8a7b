"""Components against all pairs, on families of copies, shared passages and odd rows."""

import random
import re

from askloom.llm import jaccard


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and c * den >= (len(sets[i]) + len(sets[j]) - c) * num:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))}


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        if r.random() < 0.6:
            base[5:5] = passage
        for _ in range(r.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.2:
                copy += [r.choice(vocabulary)]
            texts.append(" ".join(copy).upper() if r.random() < 0.1 else "\n".join(copy))
    texts += ["", None, "one", "One", "one two", " \n", "É x", "é x", passage and " ".join(passage), " ".join(passage)]
    r.shuffle(texts)
    return list(enumerate(texts, 1))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_HOT_LEAST", 6)
    for seed, (n, num, den), hands in ((1, (3, 90, 100), (32, 64, 256)), (2, (5, 80, 100), (2, 3)), (3, (3, 90, 100), (1,)), (4, (2, 80, 100), (2, 4))):
        monkeypatch.setattr(jaccard, "_HANDS", hands)
        rows = made(seed)
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num, den)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (None, "a b c d", None, None), (None, None, None, None), (5, "q " * 100_000, "y", 2)],
                                 "doc_id long, text string, node string, n int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows, 3, 90, 100).collect())
    assert got[1:] == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (5, 1, 5)] and got[0] == (0, 0, None)
    assert jaccard.near_duplicates(rows.limit(0)).count() == 0


def test_steps_without_links_are_not_run(spark, monkeypatch):
    """Each step is a plan in the driver's memory: what has nothing to do writes no table, and links that are stars take no round."""
    from askloom import util
    from askloom.llm import graph

    written, staged = [], util.staged
    monkeypatch.setattr(util, "staged", lambda df, label: (written.append(label), staged(df, label))[1])
    words = [f"w{i}" for i in range(40)]
    copies = [(i, " ".join([*words[:20], f"x{i}", *words[20:]])) for i in range(1, 4)]
    rows = spark.createDataFrame([*copies, (9, "quite another text of a few words")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(rows, 2, 80, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9}
    assert [written.count(x) for x in ("verified", "links", "labels")] == [1, 2, 1]  # links: as given, and one round
    written.clear()
    links = spark.createDataFrame([(2, 1), (1, 3), (5, 4), (4, 4), (None, 1)], "a long, b long")
    assert sorted(map(tuple, graph.components(links).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert written == ["links"]
