"""Block and allow rules for urls, found by hashed expressions.

A rule is a host and the start of a path. A url is expanded into expressions: the suffixes
of its host at dots, each with the starts of its path at slashes. The expressions meet the
rules in an equi-join on the first 32 bits of their SHA-256; full digests then confirm the
hit, the rest of the rule's path after its last slash is compared, and of all rules that fit
the longest wins.

Only expressions that a rule can have are made: no more host labels and no more slashes than
the largest rule has. That loses no rule and keeps a url of a thousand slashes cheap. Rules
under 32 MB are broadcast; more are joined by shuffle, with AQE splitting a host that is
very frequent.

Defined results: the host stands between the first ``://`` and the next ``/``, ``?``, ``#``
or the end, A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. A null url or one
without ``://`` has an empty host and path. A rule fits its host and all hosts that end with
a dot and its host, when the path starts with the rule's. Longest: most characters of host
and path together, then of the host; two verdicts for one rule: block. Equal rows give equal
results, as often as they come. Only the key and the url are read, so no other column can
clash. An empty table gives no rows, empty rules give every url the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.util import broadcast_if, settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _start(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"^(?s)(.*/)?", 0)


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Host suffixes of up to ``labels`` labels, each with the path's starts of up to ``slashes`` slashes."""
    def suffixes(ls: Column) -> Column:
        n = F.size(ls)
        return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(ls, n - k + 1, k), "."))

    def starts(segments: Column) -> Column:
        n = F.least(F.size(segments) - 1, F.lit(slashes))
        whole = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.array_join(F.slice(segments, F.lit(1), k), "/"), F.lit("/")))
        return F.concat(F.array(F.lit("")), whole)

    return tx.let(tx.let(F.split(path, "/"), starts), lambda ps: F.flatten(F.transform(tx.let(F.split(host, r"\."), suffixes), lambda h: F.transform(ps, lambda p: F.concat(h, p)))))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _short(digest: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row; ``rules`` has host, path and verdict.

    Rows are collapsed by key and url first, which also keeps the expressions of a url in
    the task that judges it: with broadcast rules there is no second shuffle.
    """
    settle(pages.sparkSession)
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    known = known.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # "block" after "allow"
    known = known.withColumn("r_digest", _digest(F.concat("r_host", _start(F.col("r_path"))))).withColumn("short", _short(F.col("r_digest")))
    labels, slashes = known.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1)).first()

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).groupBy("k", "u").agg(F.count("*").alias("n"))
    rows = rows.select("k", "u", "n", F.coalesce(host_of(F.col("u")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("u")), F.lit("")).alias("path"))
    each = rows.withColumn("x", F.explode(expressions(F.col("host"), F.col("path"), labels or 0, slashes or 0) if labels else F.array(F.lit(""))))
    each = each.withColumn("digest", _digest(F.col("x"))).withColumn("short", _short(F.col("digest"))).drop("x")
    met = each.join(broadcast_if(known, rules, 4), "short", "left")
    fits = F.col("digest").eqNullSafe(F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("whole"), F.length("r_host").alias("of_host"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("k", "u").agg(F.first("n").alias("n"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(fits, rank)).alias("best"))
    told = best.select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "n")
    return told.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).drop("n")
