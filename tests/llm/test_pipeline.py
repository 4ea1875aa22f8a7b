"""Each stage of the pipeline against a plain version, on what its predecessor kept."""

import hashlib
import random
import re

import numpy as np
import pytest
from test_jaccard import brute as components

import corpus_pipeline
from askloom.llm import bpe, langid, packing
from askloom.llm.queries import vocabulary


def without_runs(rows):
    """Winnowed line dedup, line by line."""
    def short(s):
        return hashlib.md5(s.encode()).hexdigest()[:16]

    prints, lines = [], {}
    for k, text in rows:
        h = [short(x) for x in text.split("\n")]
        lines[k] = h
        g = ["z" if h[i:i + 3] == [short("")] * 3 else short("".join(h[i:i + 3])) for i in range(len(h) - 2)]
        for j in range(max(len(g) - 2, 1) if g else 0):
            p = min(range(j, min(j + 3, len(g))), key=lambda i: (g[i], i))
            if g[p] != "z":
                prints.append((g[p], k, p))
    first = {}
    for g, k, p in sorted(set(prints), key=lambda x: (x[1], x[2])):
        first.setdefault(g, (k, p))
    gone = {}
    for g, k, p in set(prints):
        a, q = first[g]
        if (k, p) > (a, q):
            lo, hi = p, p + 3
            while p - lo < 2 and lo > 0 and q - (p - lo) > 0 and lines[k][lo - 1] == lines[a][q - (p - lo) - 1]:
                lo -= 1
            while hi - p < 5 and hi < len(lines[k]) and q + hi - p < len(lines[a]) and lines[k][hi] == lines[a][q + hi - p]:
                hi += 1
            gone.setdefault(k, set()).update(range(lo, hi))
    return {k: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(k, ())) for k, text in rows}


def made():
    r = random.Random(5)
    speech = {"en": "the of and ing tion that with for was this", "de": "der die und keit schaft ein mit von auf ist", "fr": "le les de que est pour eau dans une par"}
    rows, k = [], 0
    shared = {}
    for lang, syllables in speech.items():
        s = syllables.split()
        line = lambda: " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(r.randint(4, 12)))  # noqa: E731,B023
        shared[lang] = [line() for _ in range(7)]
        for _ in range(40):
            body = [line() for _ in range(r.randint(1, 9))]
            if r.random() < 0.5:
                a = r.randint(0, 3)
                body[1:1] = shared[lang][a:a + r.randint(1, 7)]
            if r.random() < 0.2:
                body.append("card 4111111111111111 at 10.1.2.3 mail a.b@c.example.org on 2020-05-06")
            rows.append((k, "\n".join(body), lang, "s", 0))
            k += 1
            if r.random() < 0.3:
                copy = body[:]
                copy[0] = copy[0] + " " + r.choice(s)
                rows.append((k, " ".join(copy), lang, "s", 0))
                k += 1
    rows += [(k, None, "en", "s", 0), (k + 1, "", "en", "s", 0), (k + 2, "123 456 ...", None, "s", 0), (k + 3, rows[3][1], "de", None, None), (3, *rows[3][1:])]
    r.shuffle(rows)
    return rows


def test_stages(spark, tmp_path):
    rows = made()
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        out = stage(spark, now, "")
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, now.collect())

    before, after = seen["language_id"]
    table = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(table.filter(~langid.held_out()))
    least = langid.least_score(model, corpus_pipeline.LEAST_CERTAINTY)
    gone = {r.doc_id for r in langid.predict(table, model).collect() if r.lang_pred == "und" or r.score < least}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == gone and len(gone) < 10
    assert gone >= {r.doc_id for r in before if not re.search("[a-z]", r.text or "")}
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = seen["line_dedup"]
    want = without_runs(sorted({(r.doc_id, r.text) for r in before}))
    assert {r.doc_id: r.text for r in after} == {k: t for k, t in want.items() if t.strip()}
    assert sum(len(t) for t in want.values()) < sum(len(t) for _, t in {(r.doc_id, r.text) for r in before})

    before, after = seen["near_duplicates"]
    group = components(sorted({(r.doc_id, r.text) for r in before}), 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted(k for k, (_, c) in group.items() if c == k)
    assert len(after) < len({r.doc_id for r in before})

    before, after = seen["personal_data"]
    text = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(text)
    private = ["4111111111111111", "10.1.2.3", "a.b@c.example.org", "2020-05-06"]
    assert any(p in t for t in text.values() for p in private)
    for r in after:
        assert not any(p in r.text for p in private)
        assert (r.text == text[r.doc_id]) == (not any(p in text[r.doc_id] for p in private))

    before, after = seen["packing"]
    check_packing({r.doc_id: r.text for r in before}, after, 1024)


def check_packing(texts, rows, capacity):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for k, ps in pieces.items():
        want = library.encode(texts[k] or "", add_special_tokens=False).ids + [0]
        ps.sort(key=lambda r: r.start)
        assert [i for r in ps for i in r.ids] == want
        assert [r.start for r in ps] == list(np.cumsum([0, *[r.length for r in ps]])[:-1]) and all(r.doc_tokens == len(want) for r in ps)
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *[r.length for r in rs]])[:-1])
        assert sum(r.length for r in rs) <= capacity
    return sequences


def test_packing(spark):
    r = random.Random(2)
    texts = {k: " ".join(r.choice(["alpha", "béta", "x1", "<|endoftext|>", "gamma!"]) for _ in range(r.choice([0, 1, 7, 60, 400]))) for k in range(150)}
    texts[150] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = packing.pack(df, vocabulary(), capacity=256, pool=64).collect()
    sequences = check_packing(texts, rows, 256)
    assert sum(256 - sum(r.length for r in s) for s in sequences.values()) < 256 * 4  # one sequence per pool
    assert bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).orderBy("doc_id").first().text == texts[0]
    assert packing.pack(df.limit(0), vocabulary()).count() == 0


def test_balance():
    """Costs: of the sequences that have room, the cheapest is taken, in order of descending cost."""
    out = packing.balance([5, 9, 3, 7, 4, 4], 16, 1.0, 0.1)
    assert out == [(1, 0, 9, 0, 0), (3, 0, 7, 1, 0), (0, 0, 5, 1, 7), (4, 0, 4, 0, 9), (5, 0, 4, 1, 12), (2, 0, 3, 0, 13)]
    long = packing.balance([10, 10, 10], 15, 1.0, 1.0)
    assert sum(p[2] for p in long) == 30 and max(p[3] for p in long) == 1
