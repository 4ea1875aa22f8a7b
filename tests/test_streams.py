"""Streams with state, and deletion from partitioned stores: against plain versions, over micro-batches, restarts and failures."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from askloom.sources import partitions, stores
from askloom.streaming import events as ev
from askloom.streaming import stateful

START = dt.datetime(2024, 3, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_answers_leave_on_done_or_timeout(spark):
    """Tokens out of order, a repeated event, a done that comes before its tokens, responses without done; parts with restarts."""
    rows = [
        # response, kind, sequence, minute, payload, part
        ("a", "meta", 1, 0, "m", 0), ("a", "token", 3, 2, "b", 0), ("a", "token", 2, 1, "a", 1), ("a", "done", 4, 3, "", 1),
        ("b", "done", 3, 12, "", 0), ("b", "token", 1, 10, "x", 0), ("b", "token", 1, 10, "x", 1), ("b", "citation", 2, 11, "c", 2),
        ("c", "token", 1, 20, "lost", 1), ("c", "citation", 2, 21, "c1", 1), ("c", "verify", 3, 22, "ok", 1),
        ("d", "done", 9, 30, "", 1), ("d", "token", 1, 25, "gap", 1),
        ("e", "token", 1, 4000, "open", 3), ("f", "done", 1, 700, None, 2),
    ]
    df = spark.createDataFrame([(r, k, s, at(m), p, n) for r, k, s, m, p, n in rows], "response string, kind string, sequence long, ts timestamp, payload string, part int")
    got = {r.response: r for r in ev.replayed(df, "part", lambda s: stateful.assembled_stream(s, ["response"]), [F.lit(1), F.lit(2), F.lit(3)]).collect()}
    assert {k: (r.answer, r.citations, r.verdict, r.finished, r.ttft_ms, r.n_events) for k, r in got.items()} == {
        "a": ("ab", [], None, True, 60_000.0, 4), "b": ("x", ["c"], None, True, 0.0, 3), "c": ("lost", ["c1"], "ok", False, 0.0, 3),
        "d": ("gap", [], None, True, 0.0, 2), "f": ("", [], None, True, None, 1)}  # e is still open


@pytest.mark.parametrize("seed", [1, 2])
def test_cache_answers_repeats_until_they_expire(spark, seed):
    """Against a plain cache over the requests in time order, however they arrive; entries expire, one key is hot."""
    r = random.Random(seed)
    requests = [(r.choice(["hot", "hot", "b", "c", None]), i, at(r.randint(0, 3000))) for i in range(400)]
    rows = [(q, i, t, t + dt.timedelta(minutes=r.randint(0, 29))) for q, i, t in requests]
    df = spark.createDataFrame(rows, "query string, id long, ts timestamp, arrives timestamp")
    got = ev.replayed(df, "arrives", lambda s: stateful.cached_stream(s, ["query"], ttl="45 minutes")).collect()
    last = max(t for _, _, t in requests) - dt.timedelta(hours=1)
    cache, want = {}, set()
    for q, i, t in sorted(requests, key=lambda x: (x[2], x[1])):
        hit = q in cache and t - cache[q][1] <= dt.timedelta(minutes=45)
        if not hit:
            cache[q] = i, t
        if t < last:
            want.add((q, i, hit, cache[q][0]))
    assert {(x["query"], x.id, x.hit, x.answered_by) for x in got} == want and len(got) == len(want)
    assert {h for _, _, h, _ in want} == {True, False}


@pytest.mark.parametrize("parts", [None, 3])
def test_a_table_is_a_file_or_a_folder(spark, tmp_path, parts):
    """Other tables beside it, also with a longer name, are not read."""
    from askloom.plans import QUERIES

    docs = [(i, f"some words {i % 7}", "en", "a", 12) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows in (("documents", df), ("documents.parquet_old", df.withColumn("text", F.lit("never")))):
        path = f"{tmp_path}/{name}.parquet"
        if parts:
            rows.repartition(parts).write.parquet(path)
        else:
            rows.toPandas().to_parquet(path)
    got = QUERIES["stream_ingest_incremental"].run(spark, str(tmp_path)).collect()
    assert {(r.term, r.df, r.n_chunks) for r in got} == {(t, n, 7) for t, n in [("some", 7), ("words", 7), *((str(i), 1) for i in range(7))]}


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*.parquet", recursive=True)}


def audit_store(spark, path):
    rows = [(i, START + dt.timedelta(days=i % 20, hours=i % 24), f"TKT-{i}" if i % 7 == 0 and i % 20 != 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, ticket_id string")
    for part in range(2):  # two micro-batches
        ev.day_batch(path)(df.filter(f"event_id % 2 = {part}"), part)
    ev.day_batch(path)(df.filter("event_id % 2 = 1"), 1)  # one is replayed
    schema = df.select("*", F.to_date("ts").alias("day"), F.lit(0).cast("bigint").alias("batch")).schema
    now = START + dt.timedelta(days=35, hours=5)
    limit = now - dt.timedelta(days=30)
    return rows, schema, now, {i for i, t, k in rows if t >= limit or k}


def test_retention_rewrites_only_days_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows, schema, now, want = audit_store(spark, path)
    before = files_of(path)
    ev.retain(spark, path, F.lit(now), schema)
    after = files_of(path)
    assert {r.event_id for r in partitions.read_store(spark, path, schema).collect()} == want
    late = {f for f in before if f.split("day=")[1][:10] > "2024-03-06"}
    assert late and all(after.get(f) == before[f] for f in late)
    assert not [f for f in after if "day=2024-03-04" in f]  # nothing of that day carries a ticket
    ev.retain(spark, path, F.lit(now), schema)
    assert files_of(path) == after  # nothing to do, nothing rewritten


@pytest.mark.parametrize("broken", ["write_partitions", "remove", "rows"])
def test_interrupted_retention_is_completed(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "audit")
    rows, schema, now, want = audit_store(spark, path)
    with monkeypatch.context() as m:
        def fails(*a, **b):
            raise RuntimeError("executor lost")
        if broken == "rows":
            m.setattr(partitions, "_same", fails)  # dies while the kept rows are written
        else:
            m.setattr(partitions, broken, fails)
        with pytest.raises(RuntimeError):
            ev.retain(spark, path, F.lit(now), schema)
    if broken == "rows":
        assert {r.event_id for r in spark.read.schema(schema).parquet(path).collect()} == {r[0] for r in rows}
        ev.retain(spark, path, F.lit(now), schema)
    assert {r.event_id for r in partitions.read_store(spark, path, schema).collect()} == want
    assert not partitions.exists(spark, f"{path}-pending")


def test_stale_collections_are_dropped(spark, tmp_path):
    """Old user collections go with their folders, also with odd names; unknown age, other names and young ones stay untouched."""
    path = str(tmp_path / "kb")
    names = ["user_a/b=c", "user_old", "user_young", "user_unknown", "main"]
    chunks = spark.createDataFrame([(f"{n}{i}", n) for n in names for i in range(3)], "chunk_id string, collection string")
    partitions.write_partitions(chunks, path, ["collection"])
    before = files_of(path)
    ages = spark.createDataFrame([("user_a/b=c", at(0)), ("user_old", at(10)), ("user_young", at(200)), ("user_unknown", None), ("main", at(0))], "collection string, created_at timestamp")
    stores.purge_stale(spark, path, ages, F.lit(at(240)), chunks.schema)
    left = partitions.read_store(spark, path, chunks.schema)
    assert {r.collection for r in left.collect()} == {"user_young", "user_unknown", "main"}
    after = files_of(path)
    assert set(after) < set(before) and all(before[f] == t for f, t in after.items())


def test_stale_collections_of_a_bucketed_store(spark, tmp_path):
    """Many collections in few folders: stale ones lose their rows, buckets without one keep their files."""
    path = str(tmp_path / "kb")
    names = [f"user_{i}" for i in range(200)] + ["user_a/b=c", "main_1", None]
    chunks = spark.createDataFrame([(f"{n}-{i}", n) for n in names for i in range(2)], "chunk_id string, collection string")
    stores.write_bucketed(chunks, path, buckets=8)
    before = files_of(path)
    assert len(before) <= 9  # a null collection has a bucket as well
    old = ["user_3", "user_a/b=c", "main_1"]
    ages = spark.createDataFrame([(n, at(0) if n in old else at(200)) for n in names[:-1]] + [("user_7", None)], "collection string, created_at timestamp")
    schema = stores.bucketed(chunks, 8).schema
    stores.purge_stale_bucketed(spark, path, ages, F.lit(at(240)), schema, buckets=8)
    left = partitions.read_store(spark, path, schema).groupBy("collection").count().collect()
    assert {r.collection: r["count"] for r in left} == {n: 2 for n in names if n not in ("user_3", "user_a/b=c")}
    after = files_of(path)
    assert len([f for f, t in after.items() if before.get(f) == t]) >= 6


def test_assembly_calls_python_per_part_not_per_response(spark):
    """Null and large keys stay exact; the result is the same for one group and for many."""
    rows = [(2**62 + i if i else None, k, s, at(i + s), f"{i}", 0) for i in range(40) for s, k in enumerate(["token", "citation", "done"], 1) if i % 9 != 8 or k != "token"]
    df = spark.createDataFrame(rows, "response long, kind string, sequence long, ts timestamp, payload string, part int")
    seen = [sorted(map(str, ev.replayed(df, "part", lambda s, n=n: stateful.assembled_stream(s, ["response"], parts=n), []).collect())) for n in (1, 16)]
    assert seen[0] == seen[1] and len(seen[0]) == 40 - len(range(8, 40, 9))
