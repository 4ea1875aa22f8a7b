"""Url rules against a plain version on generated urls and rules; odd urls, empty tables, the shuffled plan."""

import random
import re

import pytest

from askloom.llm import urls


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(raw):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("example.org", "/fr/x", "block"), ("example.org", "", "block"), ("a.b", "/p/q/r", "allow"), ("b", "/p", "block"), ("b", "/p", "allow"), ("", "/z", "block")]
ODD = [None, "", "no scheme.net/", "http://", "://net/", "HTTP://WWW.EXAMPLE.NET/EN/", "http://net", "http://net/", "http://example.net?x=/en/", "http://net./z", "http://example.net:80/en/",
       "http://x.example.org/fr/xy", "http://example.org#frag/fr/", "http://a.b/p/q/rs", "http://b/pq", "http://\n.net/\n/", "a://b://net/", "http://ÉXAMPLE.net/en", "http:///z", "http://a.b" + "/p" * 5_000, "http://" + "a." * 3_000 + "net/"]


def made(n):
    r = random.Random(7)
    host = lambda: ".".join(r.choice(["a", "b", "net", "org", "example", "com", "Example", ""]) for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "/fr/", "/de/", "p", "/p/q", "x", "?", "#", "/en/"]) for _ in range(r.randint(0, 4)))
    return [r.choice(["http://", "https://", ""]) + host() + path() for _ in range(n)]


@pytest.mark.parametrize("wide", [False, True])
def test_equals_plain_version(spark, monkeypatch, wide):
    rows = [(i, u, "clash", 0, 1) for i, u in enumerate(ODD + made(1500))]
    rows += [(3, ODD[3], "other", 0, 1), (None, ODD[5], None, None, 1), (7, ODD[5], None, None, 1)] + rows[30:34] * 3
    if wide:
        monkeypatch.setattr(urls, "broadcast_if", lambda df, *a: df)
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, short int, n int").repartition(4)
    got = urls.judge(pages, urls.rule_table(spark, RULES)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *brute(r[1], RULES))) for r in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    none = urls.rule_table(spark, RULES).filter("false")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "net", "/", None, "allow")]
    assert [tuple(r) for r in urls.judge(pages, none, default="block").collect()] == [(1, "net", "/", None, "block")]
    assert urls.judge(pages.filter("false"), urls.rule_table(spark, RULES)).count() == 0


def test_equal_short_hashes_are_told_apart(spark, monkeypatch):
    """With one bit of hash every expression meets every rule of its half; full digests keep them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(urls, "_short", lambda d: F.ascii(F.hex(F.substring(d, 1, 1))) % 2)
    rows = list(enumerate(ODD[5:] + made(200)))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, RULES)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, *brute(u, RULES))) for k, u in rows)


def test_one_shuffle_with_broadcast_rules(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    plan = urls.judge(pages, urls.rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1 and "BroadcastHashJoin" in plan
