"""Runs of lines against the plain version; odd rows."""

import random

from test_pipeline import without_runs

from pyspark.sql import functions as F

from askloom.llm import lines


def test_against_plain(spark):
    r = random.Random(6)
    pool = [f"line {i}" for i in range(30)] + ["", ""]
    shared = [[r.choice(pool) for _ in range(r.randint(3, 9))] for _ in range(5)]
    rows = []
    for k in range(200):
        body = [f"own {k} {j}" if r.random() < 0.5 else r.choice(pool) for j in range(r.randint(0, 8))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(shared)
        rows.append((k, "\n".join(body)))
    rows += [(300, "same\n" * 40), (301, "same\n" * 41 + "x"), (302, "\n" * 12), (303, "\n" * 12)]
    r.shuffle(rows)
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = without_runs(sorted(rows))
    assert {k: v[0] for k, v in got.items()} == {k: t for k, t in want.items()}
    assert all(got[k][1] == t.count("\n") + 1 for k, t in rows)
    assert got[302][0] == "\n" * 12 and got[303][0] == "\n" * 12 and sum(v[2] for v in got.values()) > 100


def test_odd_tables(spark):
    long = "\n".join(f"l{i}" for i in range(5000))
    rows = [(1, long, "a", 1), (1, long, "a", 1), (2, long, "b", 2), (None, None, None, None), (None, "x\ny\nz", "c", 3), (3, "x\ny\nz", "c", 3), (4, "", None, None), (5, "p\nq", None, None), (6, "p\nq", None, None)]
    out = lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_lines string, _k int").withColumn("_lines", F.lit(7)).withColumn("k", F.lit(8)))
    assert out.columns == ["doc_id", "text", "n_lines", "_k", "_lines", "k", "n_removed"] and out.select("_lines", "k").distinct().collect() == [(7, 8)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(1, long, 0), (1, long, 0), (2, "", 5000), (None, None, 0), (None, "x\ny\nz", 0), (3, "", 3), (4, "", 0), (5, "p\nq", 0), (6, "p\nq", 0)], key=str)
    assert lines.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def long_runs(rows, least):
    """Lines to keep after all repeated runs of ``least`` words or more are deleted: every run of every document is looked up."""
    first, runs = {}, []
    for k, text in rows:
        ls = text.split("\n")
        for i in range(len(ls)):
            for j in range(i, len(ls)):
                if sum(len(x.split()) for x in ls[i:j + 1]) >= least:
                    runs.append((tuple(ls[i:j + 1]), k, i, j))
                    first.setdefault(runs[-1][0], (k, i))
    gone = {(k, x) for run, k, i, j in runs if (k, i) > first[run] for x in range(i, j + 1)}
    # blank lines alone at the edge of a run may stay
    return {(k, x) for k, x in gone if dict(rows)[k].split("\n")[x].strip()}


def removed(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.k, x - 1) for r in lines.repeated_lines(df, least_words=least).collect() for x in r.lines}


def test_every_long_run_goes(spark):
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randint(0, 999)}" for _ in range(n))
    pool = [line(r.choice([1, 2, 5, 9, 12, 20, 30])) for _ in range(25)] + ["", "", " "]
    shared = [[r.choice(pool) for _ in range(r.randint(1, 6))] for _ in range(8)]
    rows = []
    for k in range(120):
        body = [f"own {k} {j}" if r.random() < 0.5 else r.choice(pool) for j in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(shared)
        rows.append((k, "\n".join(body)))
    rows += [(200, line(60)), (201, rows[5][1]), (202, "a b\n" * 30), (203, "a b\n" * 31), (204, "")]
    rows += [(205, dict(rows)[200]), (206, "own\n" + dict(rows)[200] + "\n\nlast")]
    plain = removed(spark, rows, None)
    for least in (1, 20, 50):
        want, got = long_runs(rows, least), removed(spark, rows, least)
        assert want - plain, "the winnowing alone must miss some"
        assert want <= got
        text = {k: t.split("\n") for k, t in rows}
        assert {(k, x) for k, x in got if text[k][x].strip()} == {(k, x) for k, x in want | plain if text[k][x].strip()}


def test_edges_of_a_run_that_crosses_contexts(spark):
    """Whichever gram is the fingerprint, it first stands in another context; the run from the second document goes whole."""
    a, b, c, d, e, f = (f"{x} " * 12 + x for x in "abcdef")
    for inner in ([b, c, d], [a, b, c], [c, d, e], [b, c, d, e]):
        rows = [(1, "\n".join(["x", *inner, "y"])), (2, "\n".join([a, b, c, d, e])), (3, "\n".join(["p", a, b, c, d, e, "q"])), (4, "\n".join([f, a, b, c, d]))]
        got = {r.doc_id: r.text for r in lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least_words=50).collect()}
        assert got[1] == rows[0][1] and got[3] == "p\nq" and got[4] == f
