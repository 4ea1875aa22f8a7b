"""The registered queries of this subpackage, each beside its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import ann, bpe, divergence, jaccard, langid, licenses, lines, packing, pii, quality, resample, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_collision_ann")
def op1_collision_ann(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op2_packing")
def op2_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), vocabulary(), capacity=1024, end_id=0, ids=False)


@query("op3_ngram_jaccard", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""")
def op3_ngram_jaccard(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), n=3, num=90, den=100)


@query("op4_language_id")
def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out())


PSEUDONYM_KEY = "a key for the test tables; a user brings a secret one"


@query("op5_pii")
def op5_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "text", "n_found", "n_changed")


@query("op6_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM m, (SELECT unnest(range(13)) AS j)),
e AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT e.doc_id, string_agg(ws[e.i], ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY e.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id""")
def op6_substring_dedup(spark, folder):
    return substrings.without_repeats(table(spark, folder, "documents").select("doc_id", "text"), n=13, texts=False)


@query("op7_quality_rules", """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, t, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls,
        len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters FROM w),
tri AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(c, 0) AS n_repeat_words, n_upper, n_letters FROM n LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 25 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 25 * n_words OR 100 * n_upper > 70 * n_letters) AS kept
FROM b""")
def op7_quality_rules(spark, folder):
    rows = quality.judged(quality.ledger(table(spark, folder, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_line_dedup", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, list_transform(ls, lambda x: substr(md5(x), 1, 16)) AS h FROM l),
g AS (SELECT doc_id, h, list_transform(range(1, len(h) - 1), lambda i: CASE WHEN h[i] = b AND h[i + 1] = b AND h[i + 2] = b THEN 'z'
        ELSE substr(md5(h[i] || h[i + 1] || h[i + 2]), 1, 16) END) AS g FROM h, (SELECT substr(md5(''), 1, 16) AS b)),
f AS (SELECT DISTINCT doc_id, h, g[p] AS k, p FROM (
        SELECT doc_id, h, g, unnest(list_transform(range(1, greatest(len(g) - 2, 1) + 1), lambda j: j + list_position(g[j:j + 2], list_min(g[j:j + 2])) - 1)) AS p
        FROM g WHERE len(g) > 0) WHERE g[p] <> 'z'),
c AS (SELECT doc_id, k, p, CASE WHEN p >= 2 THEN h[p - 1] END AS b1, CASE WHEN p >= 3 THEN h[p - 2] END AS b2, h[p + 3] AS a1, h[p + 4] AS a2,
        row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM f),
u AS (SELECT doc_id, h, pos, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM (
        SELECT doc_id, h, pos, len(regexp_extract_all(ls[pos], '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT l.doc_id, h, ls, unnest(range(1, len(ls) + 1)) AS pos FROM l JOIN h USING (doc_id))) WHERE n > 0),
r AS (SELECT a.doc_id, a.h, a.pos, b.pos AS last FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.cum >= a.cum - a.n + 50),
v AS (SELECT doc_id, any_value(h) AS h, pos, min(last) AS last FROM r GROUP BY doc_id, pos UNION SELECT doc_id, any_value(h) AS h, max(pos) AS pos, last FROM r GROUP BY doc_id, last),
long AS (SELECT doc_id, pos, last, row_number() OVER (PARTITION BY array_to_string(h[pos:last], '') ORDER BY doc_id, pos) AS nth FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS i FROM long WHERE nth > 1 UNION
        SELECT DISTINCT c.doc_id, unnest(range(c.p - CASE WHEN c.b1 = s.b1 THEN CASE WHEN c.b2 = s.b2 THEN 2 ELSE 1 END ELSE 0 END,
        c.p + 3 + CASE WHEN c.a1 = s.a1 THEN CASE WHEN c.a2 = s.a2 THEN 2 ELSE 1 END ELSE 0 END)) AS i FROM c JOIN c s ON s.k = c.k AND s.nth = 1 WHERE c.nth > 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(s, chr(10) ORDER BY e.i) AS t FROM (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM l) e
         LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY e.doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed, length(coalesce(t, ''))::BIGINT AS n_kept_chars, md5(coalesce(t, '')) AS kept_md5
FROM l LEFT JOIN n ON n.doc_id = l.doc_id LEFT JOIN kept ON kept.doc_id = l.doc_id""")
def op8_line_dedup(spark, folder):
    rows = lines.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"), least_words=50)
    return rows.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("kept_md5"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary())


@query("op10_license_scan")
def op10_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query("op11_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT w.lang, source, term, sum(w.n)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(t.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l1 AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN l1 ON l1.lang = a.lang AND l1.source = a.source AND l1.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 50""")
def op11_source_divergence(spark, folder):
    return divergence.as_rows(*divergence.audit(table(spark, folder, "documents")))


# The rules of the test pages.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op12_url_filter", """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
        FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM h JOIN m USING (page_id, host, path)""")
def op12_url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


@query("op13_target_resampling")
def op13_target_resampling(spark, folder):
    drawn = resample.draw(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
