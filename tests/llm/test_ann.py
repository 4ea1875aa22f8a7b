"""Recall and scores against brute force; equal vectors, unusable rows, small tables."""

import numpy as np
import pytest

from askloom.llm import ann


def brute(ids, x, q, k):
    out = {}
    for i in q:
        s = (x * x[i]).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (x[i] * x[i]).sum())
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    rng = np.random.default_rng(3)
    n, d = 3000, 32
    x = rng.standard_normal((n, d))
    if clustered:
        x = x[rng.integers(0, 40, n)] + 0.15 * x
    x[:300] = x[0]  # one very common vector
    ids = np.arange(n) * 2
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(rows, rows.filter("vec_id % 50 = 0"), least_rows=900).collect()
    want = brute(ids, x, [i for i in range(n) if ids[i] % 50 == 0], 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(want)
    hits = 0
    for q, rows_ in by.items():
        rows_.sort()
        assert [r[0] for r in rows_] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows_, rows_[1:]))
        hits += len({r[1] for r in rows_} & {w[0] for w in want[q]})
        exact = dict(want[q])
        assert all(abs(exact[r[1]] - r[2]) < 1e-12 for r in rows_ if r[1] in exact)
        if q < 600:
            assert [r[1] for r in rows_] == [w[0] for w in want[q]]
    assert hits / (5 * len(want)) >= 0.93
    if clustered:
        assert np.mean([r.verified for r in got]) < 0.35 * 900


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1),
            (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0, 0.0], 1), (None, [1.0, 1.0], 1), (50, [-1.0, 0.0], 1), (100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1, 0.995037), (0, 2, 50, -1.0), (50, 1, 1, -0.995037), (50, 2, 0, -1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_very_large_and_small_components(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e199]), (2, [0.0, 5e-324]), (3, [-1e308, 1e308]), (4, [1e-200, 1e-200])]
    got = ann.nearest(*[spark.createDataFrame(rows, "vec_id int, embedding array<double>")] * 2, k=2).collect()
    by = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in got}
    near = round(1 / 1.01 ** 0.5, 9)
    assert by[0, 1] == (1, near) and by[0, 2] == (4, round(0.5 ** 0.5, 9)) and len(by) == 10
    assert {by[2, 1], by[2, 2]} == {(3, near_half := round(0.5 ** 0.5, 9)), (4, near_half)}


def test_keys_that_are_not_integers_are_an_error(spark):
    df = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(ValueError, match="vec_id"):
        ann.nearest(df, df)
