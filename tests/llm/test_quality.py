"""Measures against plain Python; policies and ablations from the ledger alone."""

import collections
import random
import re

import pyarrow as pa
import pytest

from askloom.llm import quality as q
from askloom.llm import spans

ODD = ["", None, "a b", "a", "a b c a b c", "x\nx\n\n \n \nx y", "é é é é", " \n", "# $ % & | < > *", "ABC def\nABC def\nabc", "a\x0bb\x0cc\x85d", "one " * 30_000]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in q.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered),
            len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))]


@pytest.mark.parametrize("size", [50, 1 << 22])
def test_measures(monkeypatch, size):
    monkeypatch.setattr(spans, "PIECE_BYTES", size)
    r = random.Random(3)
    rows = ODD + ["".join(r.choice(["a ", "b ", "cé ", "\n", "#", "D "]) for _ in range(r.randint(0, 60))) for _ in range(500)]
    got = []
    for _, _, raw, at in spans.pieces(pa.array(rows)):
        got += list(map(list, zip(*[x.tolist() for x in q.measured(raw, at)])))
    assert got == [brute(t) for t in rows]


def test_policies_and_ablation(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "short"), (3, " ".join(w + "$$$" for w in words)), (4, " ".join(words).upper()), (5, " ".join(w.upper() + "###" for w in words)),
            (6, " ".join(["a b c"] * 30)), (None, None), (1, " ".join(words))]
    ledger = q.ledger(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, failed int")).persist()
    kept = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in q.judged(ledger).collect())
    assert kept == [(0, True, False), (1, False, True), (1, False, True), (2, True, False), (3, False, False), (4, False, False), (5, False, False), (6, True, False)]
    assert [r.kept for r in q.judged(ledger, 1).filter("doc_id in (3, 4, 5)").collect()] == [True] * 3
    cost = {r.rule: (r.n_failed, r.n_only) for r in q.ablation(ledger).collect()}
    assert cost["few_words"] == (2, 2) and cost["many_symbols"] == (2, 1) and cost["capitals"] == (2, 1)
    assert q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
