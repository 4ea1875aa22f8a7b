"""Operators against brute force on small fixtures, and plan checks."""

import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.functions import fixed, maths, rules
from askloom.functions import text as tx
from askloom.functions.stem import porter
from askloom.operators import calibrate, dedup, evaluate, index, labels, metrics, models, qa, retrieve, routing, splits, tools, variants
from askloom.plans import QUERIES
from askloom.plans import domain as d
from askloom.sources import files, records, stores
from askloom import util
from askloom.util import global_rank


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_union_setting_is_off(spark, sf):
    """The setting that loses a needed shuffle after a union; results must not change from run to run."""
    runs = {frozenset(map(tuple, QUERIES["build_citations"].run(spark, sf).collect())) for _ in range(3)}
    assert len(runs) == 1
    assert spark.conf.get("spark.sql.unionOutputPartitioning", "false") == "false"


def test_batches_are_bounded_by_bytes(spark):
    """What travels to a Python worker at once follows neither the texts' length nor the lists'."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    text = util.settle(spark).range(0, 10_000, 1, 1).select(F.repeat(F.lit("abcdefghi "), 300).alias("t"))
    for df in (text, text.select(F.split("t", " ").alias("t"))):
        got = df.mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in got) == 10_000 and max(r.size for r in got) < 1.1 * util.BATCH_BYTES


def test_bm25_plan_shuffles_blocks_and_best_rows_only(spark, sf):
    """No shuffle by document: the asked terms' blocks by shard, then at most k rows per query and task."""
    tree = d.bm25_top(spark, sf, 10)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    keys = re.findall(r"Exchange hashpartitioning\(([^()]*?), \d+\)", tree)
    keys = [re.sub(r"#\d+L?", "", x) for x in keys]
    assert keys == ["query_id", "shard"]
    assert "WindowGroupLimit" in tree and "CartesianProduct" not in tree and "doc_id#" not in "".join(re.findall(r"Exchange .*", tree))


def test_scan_reads_only_needed_columns(spark, sf):
    text = index.blocks_of(d.corpus(spark, sf), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    terms = d.lexical(spark, sf).terms._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in terms  # statistics come from the blocks, no text is read again


def plain_bm25(docs, queries, k, allowed=None, k1=fixed.BM25_K1, b=fixed.BM25_B):
    """The full ranking in plain Python."""
    from collections import Counter
    from math import log
    words = {i: t.lower().split() for i, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: log(len(docs) - n + 0.5) - log(n + 0.5) for w, n in df.items()}
    floor = fixed.BM25_EPSILON * sum(idf.values()) / max(len(idf), 1)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    avgdl = sum(map(len, words.values())) / max(len(docs), 1)
    out = set()
    for q, text in queries:
        scores = []
        for i, ws in words.items():
            if allowed is None or i in allowed:
                tf = Counter(ws)
                s = round(sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avgdl)) for w in text.lower().split() if w in tf), 6)
                if s > 0:
                    scores.append((-s, i))
        out |= {(q, i, round(-s, 5), r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("seed,vocabulary,k", [(1, 400, 5), (2, 12, 10), (3, 3, 4), (4, 3000, 3)])
def test_pruned_bm25_equals_full_ranking(spark, seed, vocabulary, k, monkeypatch):
    """Random corpora with copies (ties), few and many words, words in most documents; several shards, small blocks, many queries."""
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.7)), vocabulary)}"
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 5, 30, 200])))) for i in range(500)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(150)]
    queries = [(q, " ".join(word() for _ in range(r.randint(0, 9)))) for q in range(60)] + [(90, "w1 w1 w1"), (91, "nowhere"), (92, docs[5][1])]
    monkeypatch.setattr(index, "BLOCK", 8)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    blocks = index.staged(index.blocks_of(df, "doc_id", shard_docs=70), "blocks")
    ix = index.from_counts(blocks, index.counts_of(blocks), "doc_id")
    q = spark.createDataFrame(queries, "query_id long, text string")
    show = lambda top: {(r.query_id, r.doc_id, round(r.score, 5), r["rank"]) for r in top.collect()}
    assert show(retrieve.bm25_topk(q, ix, k)) == plain_bm25(docs, queries, k)
    assert show(retrieve.bm25_topk(q, ix, k, held_rows=40)) == plain_bm25(docs, queries, k)  # cells
    some = {i for i, _ in docs if i % 3 == 0}
    allowed = df.filter("doc_id % 3 = 0").select("doc_id")
    assert show(retrieve.bm25_topk(q, ix, k, allowed=allowed)) == plain_bm25(docs, queries, k, some)


def test_shards_are_bounded_by_tokens(spark):
    """Long texts fill a shard before its number of documents does; a text above the bound is a shard of its own."""
    docs = [(i, " ".join(f"w{(i * j) % 50}" for j in range(1, n + 1))) for i, n in enumerate([0, 5, 90, 3, 300, 0, 40, 60, 1] * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    blocks = index.blocks_of(df, "doc_id", shard_docs=50, shard_tokens=100)
    sizes = blocks.groupBy("shard").agg(F.sum("sum_tf").alias("tokens"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("docs")).collect()
    assert sum(r.docs for r in sizes) == len(docs) and max(r.docs for r in sizes) <= 50
    assert max(r.tokens for r in sizes if r.docs > 1) <= 100 and {r.tokens for r in sizes if r.tokens > 100} == {300}
    queries = [(0, "w1 w7 w7"), (1, "w30 w0"), (2, "nowhere")]
    staged = index.staged(blocks, "blocks")
    top = retrieve.bm25_topk(spark.createDataFrame(queries, "query_id long, text string"), index.from_counts(staged, index.counts_of(staged), "doc_id"), 6)
    assert {(r.query_id, r.doc_id, round(r.score, 5), r["rank"]) for r in top.collect()} == plain_bm25(docs, queries, 6)


def test_pruned_bm25_keeps_string_keys(spark):
    docs = [(f"d{i % 50:03}", f"word{i % 5} common text {'rare' if i == 7 else ''}") for i in range(50)]
    ix = index.build_index(spark.createDataFrame(docs, "doc_id string, text string"), "doc_id")
    top = retrieve.bm25_topk(spark.createDataFrame([("q", "rare word3")], "query_id string, text string"), ix, 4).collect()
    assert [r.doc_id for r in sorted(top, key=lambda r: r["rank"])] == ["d007", "d003", "d008", "d013"]


def test_pruning_skips_most_postings():
    """A rare word decides: of a word that is in every document only the candidates' blocks are scored."""
    import pyarrow as pa
    from askloom.operators import ranking

    n = 20_000
    tokens = pa.array([["the"] * (1 + i % 3) + [f"x{i % 97}"] + (["rare"] if i % 2000 == 5 else []) for i in range(n)])
    batch = index._shard_blocks(pa.array(np.arange(n)), tokens)
    rows = pa.Table.from_batches([batch]).filter(pa.compute.is_in(batch.column("term"), pa.array(["rare", "the"])))
    asked = ranking.Asked(pa.array([1, 1]), pa.array(["rare", "the"]), np.array([8.0, 0.1]), 5)
    asked.feed(ranking.Shard(rows, asked.terms, 1.5, 0.75, 3.0))
    assert len(asked.ids) == 5 and set(asked.ids % 2000) == {5}
    assert asked.scored < 0.1 * n


def test_retrieval_basics(spark):
    docs = spark.createDataFrame([
        (1, "reset your password from the login page"), (2, "refund policy for annual plans"), (3, "password rules and length"), (4, "shipping times")], "doc_id bigint, text string")
    ix = index.build_index(docs, "doc_id")
    q = spark.createDataFrame([(1, "reset password"), (2, ""), (3, "refund")], "query_id bigint, text string")
    top = retrieve.bm25_topk(q, ix, 2).collect()
    assert [r.doc_id for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == 1][0] == 1
    assert not [r for r in top if r.query_id == 2]
    assert len([r for r in top if r.query_id == 3]) <= 2


def test_index_grows_without_reading_old_texts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    old, new = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    old.write.parquet(str(tmp_path / "old"))
    new.write.parquet(str(tmp_path / "new"))
    index.save_index(index.build_index(spark.read.parquet(str(tmp_path / "old")), "doc_id"), str(tmp_path / "index"))
    grown = index.extend(index.load_index(spark, str(tmp_path / "index"), "doc_id"), spark.read.parquet(str(tmp_path / "new")))
    assert not [f for f in grown.terms.inputFiles() + grown.postings.inputFiles() if "/old/" in f]
    whole = index.build_index(docs, "doc_id")
    show = lambda ix: {(r.term, r.df, r.ctf, round(r.idf, 9)) for r in ix.terms.collect()}
    assert show(grown) == show(whole)
    assert {tuple(r) for r in grown.postings.collect()} == {tuple(r) for r in whole.postings.collect()}
    for i, part in enumerate((old, new, new)):
        index.write_segment(part, str(tmp_path / "segments"), min(i, 1), "doc_id")  # the last one is written again
    assert show(index.load_segments(spark, str(tmp_path / "segments"), "doc_id", "bigint")) == show(whole)


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    import datetime as dt

    from askloom.streaming import events as ev

    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    rows = [(1, day(1), 0), (2, day(2), 0), (3, day(5), 1), (4, day(1), 2), (5, day(6), 2), (6, day(9), 3)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, part int")
    audit = lambda s: s.select(
        "event_id", "ts", F.lit("s").alias("session_id"), F.lit("m").alias("model_tag"), F.lit(1.0).alias("latency_ms"), F.lit(None).cast("string").alias("ticket_id"))
    closed = ev.replayed(df, "part", lambda s: ev.windowed_metrics(audit(s), "1 day"), [F.lit(1), F.lit(2), F.lit(3)])
    got = {(r.start.day, r.n) for r in closed.collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1)}  # row 4 comes after its day was closed; the ninth is still open


def test_linear_metrics_on_a_long_answer(spark):
    rnd = random.Random(9)
    a = [rnd.choice(["alpha", "beta", "gammas", "gammat", "x1"]) + str(rnd.randrange(900)) for _ in range(20_000)]
    b = a[::3] + ["gammau1"] * 5
    import time
    start = time.time()
    row = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(
        metrics.rouge_n(tx.tokens_alnum("a"), tx.tokens_alnum("b"), 1)["recall"].alias("r"), metrics.grounding("a", "b").alias("g")).first()
    from collections import Counter
    assert row.r == pytest.approx(sum((Counter(a) & Counter(b)).values()) / len(b))
    known = set(b)
    heads = {t[:5] for t in known if len(t) >= 5}
    assert row.g == pytest.approx(sum(1.0 if t in known else 0.6 if len(t) >= 5 and t[:5] in heads else 0.0 for t in a) / len(a))
    assert time.time() - start < 30


def test_short_items_are_found_by_their_first_characters(spark):
    docs = spark.createDataFrame([(1, "a rose is a rose"), (2, "prose"), (3, "x"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rose"), (2, "a rose"), (3, "x"), (4, "se is"), (5, "rose is a"), (6, ""), (7, "is a rose is"), (8, "os")], "query_id long, text string")
    got = {tuple(r) for r in retrieve.containing_docs(docs, items).select("query_id", "doc_id").collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, 3), (4, 1), (5, 1), (8, 1), (8, 2)}


def test_random_negatives_are_complete(spark):
    gold = spark.createDataFrame([(1, d) for d in range(40)] + [(2, 50), (3, 51), (3, 52)], "query_id long, doc_id long")
    got = labels.random_negatives(gold.select("query_id").distinct(), gold, 3).collect()
    per = {q: [r.doc_id for r in got if r.query_id == q] for q in (1, 2, 3)}
    assert sorted(per[1]) == [50, 51, 52] and all(len(set(v)) == 3 for v in per.values())
    assert not set(per[3]) & {51, 52} and not set(per[2]) & {50}


def test_dense_grid_equals_one_block_and_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[150:] = v[0]  # a third of the vectors are copies: ties must go to the smaller id
    vec = spark.createDataFrame([(i, x.astype("float32").tolist()) for i, x in enumerate(v)], "doc_id bigint, embedding array<float>")
    q = vec.filter("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    a = {tuple(r) for r in retrieve.dense_topk(q, vec, 7).select("query_id", "doc_id", "score", "rank").collect()}
    b = {tuple(r) for r in retrieve.dense_topk(q, vec, 7, block=4, shard=33).select("query_id", "doc_id", "score", "rank").collect()}
    s = np.round(v.astype("float32").astype("float64") @ v.astype("float32").astype("float64").T, 6)
    want = {(i, j) for i in range(30) for j in sorted(range(200), key=lambda j: (-s[i, j], j))[:7]}
    assert a == b and {(x[0], x[1]) for x in a} == want


def test_dense_beyond_one_block(spark):
    """More queries and more products than are held at once; equal to brute force."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id bigint, embedding array<double>").repartition(3)
    q = vec.filter("doc_id < 2100").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id) for r in retrieve.dense_topk(q, vec, 3).collect()}
    s = np.round(v[:2100] @ v.T, 6)
    best = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert got == {(i, int(j)) for i in range(2100) for j in best[i]}


def units(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")


def vector_table(spark, v):
    return spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(v)), "embedding": list(v)}), "doc_id bigint, embedding array<float>").repartition(8).persist()


def recall_and_share(spark, v, every, k=10):
    from askloom.operators import cells

    vec = vector_table(spark, v)
    q = vec.filter(f"doc_id % {every} = 0").withColumnRenamed("doc_id", "query_id").persist()
    ix = cells.build(vec, k)
    got = {(r.query_id, r.doc_id) for r in cells.search(ix, q, k).collect()}
    want = {(r.query_id, r.doc_id) for r in retrieve.dense_topk(q, vec, k).collect()}
    share = cells.share_read(ix, q, k)
    vec.unpersist()
    q.unpersist()
    return len(got & want) / len(want), share, ix


def test_ann_recall_on_given_vectors(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        assert QUERIES["dense_topk_ann"].run(spark, folder).agg(F.avg("recall_at_10")).first()[0] >= 0.9


def test_ann_without_structure_keeps_its_recall(spark):
    recall, share, _ = recall_and_share(spark, units(np.random.default_rng(1).normal(size=(10_000, 64))), 250)
    assert recall >= 0.9 and share < 0.95


def test_ann_share_falls_on_clusters(spark):
    """The share of pairs that is scored falls as clustered vectors grow in number; folders that are not probed are not read."""
    shares = []
    for n in (4_000, 40_000):
        rng = np.random.default_rng(n)
        v = units(np.repeat(rng.normal(size=(n // 20, 16)), 20, axis=0) + 0.25 * rng.normal(size=(n, 16)))
        recall, share, ix = recall_and_share(spark, v, n // 50)
        assert recall >= 0.9
        shares.append(share)
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.1, shares
    from askloom.operators import cells
    one = vector_table(spark, v[:1]).withColumnRenamed("doc_id", "query_id")
    asked = cells.probes(ix, one, 10, "query_id").toArrow().combine_chunks()
    scan = cells._scan(ix, asked, 10, "query_id", ["query_id", "doc_id", "score"], "query_id bigint, doc_id bigint, score double")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ (=|IN) ", plan) and len(asked.column("cells")[0]) < 0.2 * len(ix.size)


def test_ann_by_groups_equals_folders_and_loaded_index(spark, tmp_path):
    """More queries than travel at once, a cell with a third of all vectors, string keys, a saved index."""
    from askloom.operators import cells

    rng = np.random.default_rng(3)
    v = units(rng.normal(size=(900, 8)))
    v[600:] = v[0]
    vec = vector_table(spark, v).select(F.format_string("k%05d", "doc_id").alias("key"), "embedding")
    q = vec.filter("key < 'k00080'").withColumnRenamed("key", "query_id")
    ix = cells.build(vec, 5, doc="key", path=str(tmp_path / "ix"))
    show = lambda df: {tuple(r) for r in df.select("query_id", "key", "score", "rank").collect()}
    a = show(cells.search(ix, q, 5))
    assert a == show(cells.search(ix, q, 5, block=7, part=50)) == show(cells.search(cells.load(spark, str(tmp_path / "ix"), "key"), q, 5))
    assert {x[1] for x in a if x[0] == "k00000"} == {"k00000", "k00600", "k00601", "k00602", "k00603"}


def test_ann_small_tables(spark):
    from askloom.operators import cells

    vec = vector_table(spark, units(np.eye(3)))
    q = vec.withColumnRenamed("doc_id", "query_id")
    assert cells.search(cells.build(vec, 10), q, 10).count() == 9
    none = vec.filter("false")
    assert cells.search(cells.build(none, 10), q, 10).count() == 0
    assert cells.search(cells.build(vec, 10), q.filter("false"), 10).count() == 0


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None  # noqa: E704
        def getConf(self): return {}  # noqa: E704
    class Session:
        sparkContext = Context()
        conf = {}
        _askloom_settled = True
    with pytest.raises(ValueError, match="checkpoint"):
        util.shared_dir(Session())


def shingles(t, n=5):
    w = t.lower().split()
    return {" ".join(w)} if len(w) < n else {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


def greedy(texts, t):
    kept = []
    for k, x in texts:
        s = shingles(x)
        if s and any(len(s & o) / len(s | o) >= t for o in kept):
            continue
        if s:
            kept.append(s)
        yield k


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("blocks", [(1,), (1, 2, 7), (1, 32, 1024)])
def test_dedup_keeps_what_the_sequential_rule_keeps(spark, exact, blocks, monkeypatch):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    base = [rnd.choices(vocab, k=60) for _ in range(6)]
    texts = []
    for i in range(60):
        w = list(base[rnd.choice([0, 0, 0, 1, 2, 3, 4, 5])])
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            w[rnd.randrange(60)] = rnd.choice(vocab)
        texts.append((i, " ".join(w)))
    texts += [(100, ""), (101, "one two"), (102, "one two")]
    run = dedup.dropped_nodes
    monkeypatch.setattr(dedup, "dropped_nodes", lambda n, k, t: run(n, k, t, blocks))
    out = dedup.keep_first(spark.createDataFrame(texts, "k bigint, text string"), "k", threshold=0.8, exact=exact)
    got = {r.k for r in out.collect() if r.kept}
    want = set(greedy([x for x in texts if x[1]], 0.8)) | {100}
    assert got == want


def test_dedup_of_a_template_takes_few_rounds(spark, monkeypatch):
    """Rows that share boilerplate and resemble each other just too little are all compared, in few rounds."""
    rnd = random.Random(8)
    frame = [f"f{i}" for i in range(300)]
    texts = [(i, " ".join(frame + [f"u{i}x{j}" for j in range(15 if i % 50 else 0)])) for i in range(1000)]
    rnd.shuffle(texts)
    rounds, run = [], dedup.dropped_nodes
    monkeypatch.setattr(dedup, "dropped_nodes", lambda n, k, t: run(n, k, t, rounds=rounds))
    out = dedup.keep_first(spark.createDataFrame(texts, "k bigint, text string"), "k", threshold=0.92)
    assert {r.k for r in out.collect() if r.kept} == set(greedy(sorted(texts), 0.92))
    assert 1 <= len(rounds) <= 5


def test_question_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = "refund account billing password shipping invoice payment limit deadline income student credit form".split()
    rows = []
    for i in range(60):
        words = rnd.sample(vocab, rnd.choice([3, 5, 7]))
        rows.append((i, "what about " + " ".join(w + ("s" if rnd.random() < 0.2 else "") for w in words) + "?"))

    rows += [(100, "abxcd?"), (101, "abcd?"), (102, "abcdefgh ijk?"), (103, "abcdefghijk?")]

    def canon(t):
            return " ".join(sorted({w for w in re.findall(r"\w+", t.lower()) if w not in fixed.CANONICAL_STOPWORDS and len(w) > 2}))

    kept, want = [], set()
    for i, t in rows:
        c = canon(t)
        if not any(SequenceMatcher(None, c, o).ratio() > 0.88 for o in kept):
            kept.append(c)
            want.add(i)
    got = {r.i for r in qa.question_dedup(spark.createDataFrame(rows, "i bigint, q string"), "i", "q").collect() if r.kept}
    assert got == want


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.88, 0.95])
def test_form_pairs_are_complete(spark, threshold):
    """Every pair above the threshold is a candidate: random strings of all lengths with edits, few and many letters."""
    r = random.Random(int(threshold * 100))
    forms = set()
    for letters in ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz "):
        for length in (*range(1, 30), 45, 80, 150, 450):
            base = "".join(r.choice(letters) for _ in range(length))
            forms.add(base)
            for edits in (1, 1, 2, length // 10 + 1, length // 5 + 1):
                x = list(base)
                for _ in range(edits):
                    at = r.randrange(len(x) + 1)
                    kind = r.randrange(3)
                    x[at:at + (kind > 0)] = [] if kind == 1 else [r.choice(letters)]
                forms.add("".join(x))
    forms = sorted(forms - {""})
    nodes = spark.createDataFrame(list(enumerate(forms)), "node long, form string")
    got = {(p.earlier, p.later) for p in qa.form_pairs(nodes, threshold).collect()}
    want = {(i, j) for j in range(len(forms)) for i in range(j) if 2 * min(len(forms[i]), len(forms[j])) > threshold * (len(forms[i]) + len(forms[j]))
            and SequenceMatcher(None, forms[j], forms[i]).quick_ratio() > threshold and SequenceMatcher(None, forms[j], forms[i]).ratio() > threshold}
    assert len(want) > 100 and want <= got


def test_a_common_word_does_not_pair_all_questions(spark):
    """A word that is in every form, short forms included, is no leading gram of any: what is left are chance pairs of rare grams."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    forms = sorted({" ".join(sorted(["common", *(word() for _ in range(r.choice([2, 3, 5])))])) for _ in range(2000)})
    forms += [f + "s" for f in forms[:50]]
    assert 50 <= qa.form_pairs(spark.createDataFrame(list(enumerate(forms)), "node long, form string"), 0.88).count() < 0.02 * len(forms) ** 2 / 2


def test_leading_grams_are_not_broadcast(spark):
    """Their copies are many times what was written; they never go through the driver."""
    forms = [(i, f"some question {i} about nothing") for i in range(30)]
    plan = qa.form_pairs(spark.createDataFrame(forms, "node long, form string"), 0.88)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_overlapping_spans_equal_brute_force(spark):
    """Spans of all lengths, empty and inverted ones, repeated rows, nulls; then a document with very many spans on both sides."""
    from askloom.operators import intervals

    r = random.Random(6)

    def spans(n, key):
        out = []
        for i in range(n):
            s = r.randrange(400)
            out.append((f"{key}{i}", r.choice([1, 2]), s, s + r.choice([-3, 0, 1, 1, 2, 5, 40, 300])))
        return out + out[:5] + [(f"{key}n", None, 1, 5), (f"{key}m", 1, None, 5)]

    left, right = spans(150, "a"), spans(120, "b")
    a = spark.createDataFrame(left, "a string, doc long, s long, e long")
    b = spark.createDataFrame(right, "b string, doc long, rs long, re long")
    got = sorted((x.a, x.b) for x in intervals.overlap_join(a, b, ["doc"], ("s", "e"), ("rs", "re")).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if None not in (*x, *y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    n = 100_000
    wide = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 12).alias("e"))
    other = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 10 + 5).alias("rs"), (F.col("id") * 10 + 8).alias("re"))
    found = intervals.overlap_join(wide, other, ["doc"], ("s", "e"), ("rs", "re")).withColumn("task", F.spark_partition_id())
    per_task = [x["count"] for x in found.groupBy("task").count().collect()]
    assert sum(per_task) == n and max(per_task) < n / 3


def test_lcs_and_rouge(spark):
    rnd = random.Random(2)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))], [rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))]) for _ in range(40)]

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r.n for r in df.select(metrics.lcs_length("a", "b").alias("n")).collect()] == [lcs(a, b) for a, b in rows]
    same = one(spark, metrics.rouge_n(tx.tokens_alnum(F.lit("the cat sat")), tx.tokens_alnum(F.lit("the cat sat")), 2)["f1"])
    assert same == 1.0


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"),
    ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("electrical", "electr"),
    ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_citation_scores(spark):
    kind = "array<struct<doc_id:string,span_start:int,span_end:int>>"

    def f1(p, g):
        return spark.createDataFrame([(p, g)], f"p {kind}, g {kind}").select(metrics.citation_scores("p", "g")["f1"]).first()[0]

    assert f1([("a", 0, 10)], [("a", 0, 10)]) == 1.0
    assert f1([], []) == 1.0 and f1([], [("a", 0, 1)]) == 0.0
    assert f1([("a", 0, 0)], [("a", 5, 9)]) == 1.0  # an empty span matches its document in full
    assert f1([("a", 0, 10)], [("a", 8, 30)]) == 0.5
    assert f1([("a", 0, 10)], [("a", 20, 30)]) == 0.25
    assert f1([("a", 0, 10), ("a", 0, 10)], [("a", 0, 10)]) == pytest.approx(2 / 3)


def test_tools_and_tickets(spark):
    assert one(spark, stores.severity_sla(F.lit("high"))) == "8h" and one(spark, stores.severity_sla(F.lit("zzz"))) == "24h"
    errs = lambda t, a: one(spark, tools.tool_arg_errors(F.col("t"), F.col("a")), t=t, a=a)
    assert errs("SearchKB", '{"query": "x", "top_k": 5}') == []
    assert errs("SearchKB", '{"top_k": 99}') == ["maximum:top_k", "missing:query"]
    assert errs("GetPolicy", "[1]") == ["not_an_object"] and errs("Nope", "{}") == ["unknown_tool"]
    pol = spark.createDataFrame([("refund-policy-3.2", 1), ("Shipping", 2)], "section_id string, pos int")
    req = spark.createDataFrame([(1, "Shipping"), (2, "REFUND"), (3, "zzz"), (4, "")], "r int, section_id string")
    got = {r.r: (r.found_id, r.fuzzy) for r in tools.policy_lookup(req, pol).collect()}
    assert got == {1: ("Shipping", False), 2: ("refund-policy-3.2", True), 3: (None, False), 4: (None, False)}


def test_text_rules(spark):
    assert one(spark, tx.split_sub_queries(F.lit("How do I reset it and also what is the refund policy?"))) == ["How do I reset it?", "what is the refund policy?"]
    assert one(spark, tx.small_talk_class(F.lit("hey there!"))) == "greeting"
    assert one(spark, tx.small_talk_class(F.lit("hey how do I reset my password?"))) is None
    assert one(spark, tx.refine_query(F.lit("q"), F.array(F.lit("b"), F.lit("a"), F.lit("a")), F.lit(9))) == "q\nDescribe step by step how this works.\nExclude: a; b"
    assert one(spark, rules.table_like(F.lit("a|b|c\n" * 8))) is True
    assert one(spark, rules.diversify(F.lit("When must I pay"), F.lit(0.1), F.lit(0.0))) == "In which cases must I pay"
    assert one(spark, files.safe_stem(F.lit("/x/My report (1).pdf"))) == "Myreport1"
    assert one(spark, records.ticket_id_of(F.lit("k"))).startswith("TKT-")


def test_global_rank_and_splits(spark):
    rows = spark.range(0, 1000).select((F.col("id") % 7).alias("g"), F.col("id"))
    ranked = {r.id: r["rank"] for r in global_rank(rows, [F.col("g"), F.col("id")]).collect()}
    want = {i: n + 1 for n, i in enumerate(sorted(range(1000), key=lambda i: (i % 7, i)))}
    assert ranked == want
    tiny = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "k int, d string")
    counts = {(r.d, r.split): r["count"] for r in splits.split_exact(tiny, "k", "d").groupBy("d", "split").count().collect()}
    assert counts == {("a", "train"): 1, ("a", "val"): 1, ("a", "test"): 1, ("b", "test"): 1}
    with pytest.raises(ValueError):
        splits.split_exact(tiny, "k", "d", (0.5, 0.5, 0.5))


def test_bootstrap_bounds(spark):
    rows = spark.createDataFrame([(m, q, float(q % 5) + (0.0 if m == "a" else s)) for m, s in (("a", 0), ("b", 0.0), ("c", 3.0)) for q in range(50)], "model_tag string, query_id int, fcrs double")
    p = {r.model_tag: r.p_value for r in evaluate.bootstrap_p(rows, "a", reps=200).collect()}
    assert p["b"] == 1.0 and p["c"] in (0.0, 1.0)
    noisy = spark.createDataFrame([(m, q, float((q * 37) % 11) + (0.0 if m == "a" else float((q * 13) % 7) - 1.0)) for m in ("a", "b") for q in range(80)], "model_tag string, query_id int, fcrs double")
    assert evaluate.bootstrap_p(noisy, "a", reps=300).first().p_value < 0.05


def test_bootstrap_draws_exactly_as_many_pairs(spark):
    rng = np.random.default_rng(8)
    n, reps = 150, 400
    base, other = rng.normal(size=n), rng.normal(size=n)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(base)] + [("b", i, float(v + w * 1.5 + 0.15)) for i, (v, w) in enumerate(zip(base, other))]
                                 + [("c", 1, None), ("c", 2, 0.5)], "model_tag string, query_id int, fcrs double")
    at, totals = evaluate.numbered_differences(rows, "a", "fcrs", "query_id")
    drawn = evaluate.block_draws(at, totals, reps, block=16)
    sums = drawn.groupBy("model_tag", "rep").agg(F.sum("c").alias("c"), F.max("n").alias("n")).collect()
    assert len(sums) == 2 * reps and all(r.c == r.n for r in sums)
    assert drawn.filter("model_tag = 'b'").select("block").distinct().count() == 10
    d = other * 1.5 + 0.15
    want = np.mean(np.abs(d[rng.integers(0, n, (20000, n))].mean(axis=1) - d.mean()) >= abs(d.mean()))
    for block in (16, 4096):
        got = {r.model_tag: r.p_value for r in evaluate.bootstrap_p(rows, "a", reps=reps, block=block).collect()}
        assert abs(got["b"] - want) < 0.1 and got["c"] == 0.0
    assert evaluate.bootstrap_p(rows.filter("model_tag <> 'b'").withColumn("fcrs", F.lit(None).cast("double")), "a", reps=5).first().p_value == 1.0


def test_own_collections_in_cells(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 6)), 3)
    group = [None if i == 7 else 0 if i % 3 else i % 5 for i in range(400)]
    schema = "id int, g int, embedding array<double>"
    rows = spark.createDataFrame([(i, group[i], None if i == 11 else [float(x) for x in v[i]]) for i in range(400)], schema)
    q, docs = rows.filter("id % 4 = 1").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "doc_id")
    for block, shard in ((2048, 50_000), (7, 20)):
        got = {}
        for r in retrieve.dense_topk_within(q, docs, 3, "g", block=block, shard=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        for i in range(1, 400, 4):
            mates = [] if i in (7, 11) else [(j, round(float(v[i] @ v[j]), 6)) for j in range(400) if group[j] == group[i] and j not in (7, 11)]
            assert got.get(i, []) == sorted(mates, key=lambda x: (-x[1], x[0]))[:3]


def test_classifiers_are_held_to_unseen_rows(spark):
    rng = np.random.default_rng(5)
    y = rng.choice(3, 600, p=(0.8, 0.1, 0.1))
    x = rng.normal(size=(600, 4)) + 4 * np.eye(3, 4)[y]
    rows = spark.createDataFrame([(i, int(c), [float(t) for t in r]) for i, (c, r) in enumerate(zip(y, x))], "k int, y int, v array<double>")
    _, scored = models.fit_classifier(rows, "v", "y", "k", multinomial=True)
    held = scored.filter("held_out")
    share = {r.y: r.s for r in held.groupBy("y").agg(F.avg(F.col("correct").cast("int")).alias("s")).collect()}
    assert 60 < held.count() < 180 and set(share) == {0, 1, 2} and min(share.values()) > 0.8


def test_calibration(spark):
    rows = spark.createDataFrame([(i, "m", 0.8, 1 if i % 5 else 0) for i in range(50)], "id int, tag string, c double, y int")
    assert calibrate.ece(rows, ["tag"], "c", "y").first().ece == pytest.approx(0.0, abs=1e-9)
    perfect = spark.createDataFrame([(i, i / 10, 1 if i > 5 else 0) for i in range(10)], "id int, c double, y int")
    assert calibrate.auroc(perfect, "c", "y", "id").first().auroc == 1.0
    assert calibrate.auroc(perfect.withColumn("y", F.lit(1)), "c", "y", "id").first().auroc is None


def test_random_negatives_are_not_gold(spark, sf):
    neg, gold = QUERIES["random_negatives"].run(spark, sf), d.gold(spark, sf)
    assert neg.join(gold, ["query_id", "doc_id"], "left_semi").count() == 0
    assert neg.groupBy("query_id").count().filter("count > 2").count() == 0


def test_action_loop_invariants(spark, sf):
    rows = QUERIES["action_loop"].run(spark, sf).collect()
    assert len({r.query_id for r in rows}) == len(rows) == d.queries(spark, sf).count()
    assert {r.iterations for r in rows} <= {1, 2}
    for r in rows:
        if r.action == "answer":
            assert r.confidence >= fixed.CONF_HIGH
        if r.action == "ticket":
            assert r.reason in ("low_confidence", "no_candidates")


def test_full_responses(spark, sf):
    rows = QUERIES["loop_responses"].run(spark, sf).collect()
    assert len({r.query_id for r in rows}) == len(rows) == d.queries(spark, sf).count()
    for r in rows:
        tools_ = [c.tool for c in r.tool_calls]
        cited = [c.doc_id for c in r.citations or []]
        wide = [c.doc_id for c in r.grounding_citations or []]
        assert set(cited) <= set(wide) and wide == (r.retrieved or [])[:5] and all(len(c.cited_text) <= 2000 for c in r.grounding_citations or [])
        assert (r.action == "ticket") == (r.ticket_id is not None) == (tools_[-1] == "CreateTicket") == (r.answer is None)
        assert r.iterations == 1 + max(c.iteration for c in r.tool_calls)
        assert (r.verify_verdict is not None) == (tools_[-1] == "AnswerVerify")
        first = [c for c in r.tool_calls if c.iteration == 0]
        assert all(c.confidence_before is None for c in first)
        if r.iterations == 2:
            assert first[-1].tool in ("SearchKB", "GetPolicy", "AnswerVerify") and first[-1].result
            assert all(c.confidence_before == first[-1].confidence_after for c in r.tool_calls if c.iteration == 1)


def test_variants_run_their_stages(spark, sf):
    rows = QUERIES["variant_runs"].run(spark, sf).collect()
    by = {t: {r.query_id: r for r in rows if r.tag == t} for t in fixed.VARIANTS}
    n = d.queries(spark, sf).count()
    assert all(len(x) == n for x in by.values()) and len(rows) == n * len(by)
    for t in ("m1", "m2"):
        assert {r.iterations for r in by[t].values()} == {0} and {tuple(r.tools) for r in by[t].values()} <= {("AnswerDirect",), ("CreateTicket",)}
    for t, f in fixed.VARIANTS.items():
        judged = {r.query_id for r in by[t].values() if r.verify_verdict is not None or "AnswerVerify" in r.tools}
        assert f["verify"] or not judged
        assert f["decomposition"] or {r.n_parts for r in by[t].values()} == {1}
        assert not f["action_loop"] or {r.iterations for r in by[t].values()} <= {1, 2}
    split = {r.query_id for r in d.queries(spark, sf).filter(tx.multi_part_by_split("text") & (F.size(tx.split_sub_queries("text")) > 1)).collect()}
    assert {q for q, r in by["m5"].items() if r.n_parts > 1} == split
    assert all(by["m5"][q].answer.startswith("For [") for q in split if by["m5"][q].answer)


def test_variant_parts(spark):
    q = spark.createDataFrame([(1, "What is the fee? When is it due?"), (2, "Who files it?"), (3, "")], "query_id bigint, text string")
    got = [(r.query_id, r.text) for r in variants.parts_of(q, True).orderBy("query_id").collect()]
    assert got == [("1/0", "What is the fee?"), ("1/1", "When is it due?"), ("2/0", "Who files it?"), ("3/0", "")]
    assert variants.parts_of(q, False).count() == 3


def test_verify_skips_confident_answers(spark):
    a = spark.createDataFrame([(1, "The sky is blue.", 0.9), (2, "The sky is blue.", 0.1), (3, "Nothing here.", 0.1)], "k int, answer string, c double")
    c = spark.createDataFrame([(1, "d", 1, "blue sky is the"), (2, "d", 1, "the sky is blue")], "k int, doc_id string, rank int, cited_text string")
    got = {r.k: r.verdict for r in routing.verify_answers(a, c, "k", confidence="c").collect()}
    assert got == {1: "skipped", 2: "pass", 3: "fail"}


def test_parser_errors_become_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny")
    (tmp_path / "b.bad").write_text("boom")

    def broken(content, path):
        raise RuntimeError("no")

    got = files.parsed_blocks(files.binary_files(spark, str(tmp_path)), {".txt": lambda b, p: ({"text": t} for t in b.decode().split("\n")), ".bad": broken}).collect()
    assert sorted(r.text for r in got if r.text) == ["x", "y"] and any("RuntimeError" in (r._error or "") for r in got)
    (tmp_path / "l.json").write_bytes(b"caf\xe9 text")
    t = files.text_blocks(files.binary_files(spark, str(tmp_path)).filter(F.endswith("path", F.lit("l.json")))).first().text
    assert t == "café text"


def test_pandas_scorer_matches_default(spark):
    pairs = spark.createDataFrame([(1, 1, "a b", "a c"), (1, 2, "a b", "a b")], "query_id int, doc_id int, query_text string, doc_text string")

    def share(left, right):
        return left.combine(right, lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split())))

    a = retrieve.rerank_topk(pairs, 2).select("doc_id", "score").collect()
    b = retrieve.rerank_topk(pairs, 2, retrieve.pandas_scorer(share)).select("doc_id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_corrupted_answers_differ_and_cover_all_kinds(spark, sf):
    from askloom.plans.q_labels import corrupted
    rows = corrupted(spark, sf).collect()
    assert {r.rejection_type for r in rows} == set(fixed.REJECTION_TYPES)
    assert all(r.rejected.strip() != r.chosen.strip() for r in rows)
    assert labels.GENERAL_KNOWLEDGE.strip() in next(r.rejected for r in rows if r.rejection_type == "no_citation")


def test_maths(spark):
    assert one(spark, maths.span_iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15))) == pytest.approx(1 / 3)
    assert one(spark, maths.recall(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(2)), 20)) == 0.5  # repeats stay in the denominator
    assert sum(one(spark, maths.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))) == pytest.approx(1)


def test_interpolated_percentiles(spark):
    """Equal to numpy's linear percentiles, with nulls, ties, single rows and a group of equal values."""
    from askloom.operators import audit
    r = np.random.default_rng(2)
    values = {"a": r.integers(0, 30, 400).astype(float).tolist(), "b": [5.0], "c": [7.0] * 300, "d": [1.0, 4.0], "e": []}
    rows = [(g, i, v) for g, vs in values.items() for i, v in enumerate([*vs, None])]
    df = spark.createDataFrame(rows, "model_tag string, query_id long, ms double").repartition(5)
    got = {x.model_tag: (x.p50, x.p95, x.p0, x.p100) for x in audit.interpolated(df, "model_tag", "ms", "query_id", {"p50": 50, "p95": 95, "p0": 0, "p100": 100}).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for g, x in got.items():
        assert np.allclose(x, np.percentile(values[g], [50, 95, 0, 100])), g
    assert audit.interpolated(df.limit(0), "model_tag", "ms", "query_id", {"p50": 50}).count() == 0


def test_argument_f1_of_tool_calls(spark, sf):
    """The best call of the needed tool counts; without arguments on either side the name does."""
    args = "CASE WHEN needed_tool IS NOT NULL AND query_id % 2 = 0 THEN map('query', 'pay', 'top_k', '5') END"
    gold = d.gold_rows(spark, sf).limit(40).withColumn("needed_args", F.expr(args))
    calls = F.transform("tools", lambda t: F.when(F.col("query_id") % 4 == 0, F.create_map(F.lit("query"), F.lit(" Pay "), F.lit("top_k"), F.lit("7"))).otherwise(F.create_map(F.lit("query"), F.lit("PAY"), F.lit("top_k"), F.lit("5"))))
    responses = d.responses(spark, sf)
    plain = {(r.model_tag, r.query_id): r for r in evaluate.per_query(responses, gold).select("model_tag", "query_id", "tool_name_match", "tool_arg_f1").collect()}
    judged = evaluate.per_query(responses.withColumn("tool_args", calls), gold).select("model_tag", "query_id", "tool_name_match", "tool_arg_f1").collect()
    assert len(judged) == len(plain) > 0
    assert all(r.tool_arg_f1 == r.tool_name_match for r in plain.values())
    for r in judged:
        want = r.tool_name_match if r.query_id % 2 or not r.tool_name_match else 0.5 if r.query_id % 4 == 0 else 1.0
        assert r.tool_arg_f1 == want, r
    assert {0.5, 1.0} <= {r.tool_arg_f1 for r in judged}


def test_unit_vectors_agree_on_zero_vectors(spark, tmp_path):
    """A zero vector has no direction and stays zero in query and twin; tiny and large components, and rounding of decimal halves."""
    from compare import compare, duck

    rows = [(1, [0.0, 0.0, 0.0], 0), (2, [3.0, -4.0, 0.0], 0), (3, [1e-6, 1.0, -1e-7], 0), (4, [1e20, 0.0, 1.0], 0)]
    pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "int32"}).pipe(
        lambda df: df.assign(embedding=[np.array(x, np.float32) for x in df["embedding"]])).to_parquet(tmp_path / "embeddings.parquet")
    con = duck(str(tmp_path))
    assert compare(spark, con, str(tmp_path), QUERIES["fn_l2_normalize"]) == (4, "")
    halves = [(k + 0.5) / 1e6 for k in range(100, 2000, 7)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(halves)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert got == [con.execute("SELECT ?::DOUBLE::VARCHAR::DECIMAL(38, 6)::DOUBLE", [x]).fetchone()[0] for x in halves]


def test_counters_judge_each_output_once(spark, sf):
    """One scan, and no filter that parses again; states without rows have none, skip_dup always has one."""
    from askloom.plans import q_chunks

    plan = qa.build_counters(q_chunks.outs(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and not re.search(r"Filter .*from_json", plan)
    text = "the fee must be paid within 3 days if the form is late and due."
    good = '{"query": "When must the late fee be paid?", "answer": "The fee must be paid within 3 days if the form is late."}'
    rows = [("a", "d", text, good, ""), ("b", "d", text, "none", good), ("c", "d", text, good.replace("When", "What"), ""), ("e", "d", text, good, "")]
    for n in (4, 1, 0):
        outs = spark.createDataFrame(rows[:n], "chunk_id string, doc_id string, text string, raw string, raw_retry string")
        judged = [(r.state, r.query) for r in qa.judged(outs).collect()]
        canon = {q: one(spark, tx.canonical_string("q"), q=q) for s, q in judged if s != "skip_invalid"}
        want = {s: sum(x == s for x, _ in judged) for s, _ in judged} | {"skip_dup": sum(s != "skip_invalid" for s, _ in judged) - len(set(canon.values()))}
        assert {r.reason: r.n for r in qa.build_counters(outs).collect()} == want
        assert n < 4 or want == {"first_ok": 3, "retry_ok": 1, "skip_dup": 2}


def syllable_forms(r, n):
    """Forms of sorted words of common syllables: no gram is rare, few pairs are alike."""
    parts = "an er tion re ing st th ed on ou ly en ti at or nt ha es wh he".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.choice([2, 2, 3, 4])))
    forms = {" ".join(sorted(word() for _ in range(r.choice([6, 12, 18, 24])))) for _ in range(n)}
    for f in sorted(forms)[::10]:
        at = r.randrange(len(f))
        forms.add(f[:at] + "x" + f[at + 1:])
    return sorted(forms)


def test_forms_without_rare_grams_are_paired_exactly(spark, monkeypatch):
    """What is compared in Python are the like pairs and hardly any others, over many blocks."""
    forms = syllable_forms(random.Random(4), 300)
    monkeypatch.setattr(qa, "BLOCK_CHARS", 8_000, raising=False)
    got = {(p.earlier, p.later) for p in qa.form_pairs(spark.createDataFrame(list(enumerate(forms)), "node long, form string"), 0.88).collect()}
    size = len(forms)
    want = {(i, j) for j in range(size) for i in range(j) if SequenceMatcher(None, forms[j], forms[i]).quick_ratio() > 0.88
            and SequenceMatcher(None, forms[j], forms[i], autojunk=False).ratio() > 0.88}
    assert len(want) >= 20 and want <= got and len(got) < 0.002 * size ** 2 / 2


@pytest.mark.parametrize("wide", [0, 64])
def test_like_pairs_equal_the_longest_common_subsequence(wide, monkeypatch):
    """One block and two, strings over one and several words of 64 places, on machine words and on whole numbers."""
    from askloom.operators import likeness

    def common(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            old, row = row, [0]
            for j, e in enumerate(b):
                row.append(old[j] + 1 if c == e else max(old[j + 1], row[j]))
        return row[-1]

    monkeypatch.setattr(likeness, "WIDE", wide)
    r, forms = random.Random(6), set()
    for letters in ("ab", "abcdefgh ", "aéñüç中😀"):
        for length in (1, 2, 7, 30, 64, 65, 140):
            base = "".join(r.choice(letters) for _ in range(length))
            forms |= {base, base[: length // 2] + "b" + base[length // 2:], base[length // 9:] + "a" * r.randrange(length // 9 + 1)}
    forms = sorted(forms - {""}, key=len)
    for threshold in (0.7, 0.88):
        like = lambda i, j: 2.0 * common(forms[i], forms[j]) / (len(forms[i]) + len(forms[j])) > threshold
        want = {(i, j) for j in range(len(forms)) for i in range(j) if like(i, j)}
        got = set(zip(*(z.tolist() for z in likeness.like_pairs(forms, None, threshold))))
        cut = len(forms) // 2
        x, y = likeness.like_pairs(forms[:cut], forms[cut:], threshold)
        assert want and got == want and set(zip(x.tolist(), (y + cut).tolist())) == {(i, j) for i, j in want if i < cut <= j}


def rows_with_frequent_passages(r, n):
    """Texts that share long frequent passages, edited copies, exact copies, short and empty texts, odd white space and letters."""
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "ß", "İx"]
    common = [r.choices(vocab, k=70) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = i % 4
        words = list(r.choice(common)) + r.choices(vocab, k=r.choice([0, 4, 12, 90])) if kind < 2 else r.choices(vocab, k=r.choice([1, 3, 5, 40]))
        if kind == 3 and rows:
            words = r.choice(rows)[1].split() or ["x"]
            for _ in range(r.choice([0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i, r.choice([" ", "\t", " \n"]).join(words)))
    return rows + [(n, ""), (n + 1, "  \n"), (n + 2, None)]


def test_exact_dedup_holds_no_whole_sets(spark, monkeypatch):
    """Equal to the sequential rule with frequent members last in prefixes; what is written for all rows are prefixes."""
    rows = rows_with_frequent_passages(random.Random(12), 240)
    r = spark.createDataFrame(rows, "k bigint, text string")
    monkeypatch.setattr(dedup, "HOT_LEAST", 5, raising=False)
    written, stage = [], dedup.staged
    monkeypatch.setattr(dedup, "staged", lambda df, label: written.append(out := stage(df, label)) or out)
    kept = {x.k for x in dedup.keep_first(r, "k", threshold=0.85, exact=True).collect() if x.kept}
    plain = [(k, t) for k, t in rows if t and t.strip()]
    assert kept == set(greedy(plain, 0.85)) | {240, 241, 242}
    longest = sum(len(shingles(t)) for _, t in plain)
    listed = [(df, c) for df in written for c, kind in df.dtypes if kind == "array<bigint>"]
    assert listed and all(df.agg(F.sum(F.size(c))).first()[0] < 0.4 * longest for df, c in listed)
    got = {(x.kept, x.dropped): x.jaccard for x in dedup.removal_pairs(r, "k", threshold=0.85).collect()}
    sets = {k: shingles(t) for k, t in plain}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in kept & set(sets) for b in set(sets) - kept}
    want = {p: j for p, j in want.items() if p[0] != p[1] and j >= 0.85}
    named = {}
    for k in sorted(sets):
        named.setdefault(frozenset(sets[k]), k)
    assert want and {p: j for p, j in got.items()} == {(a, b): j for (a, b), j in want.items() if named[frozenset(sets[a])] == a}
