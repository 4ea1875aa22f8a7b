"""Windows, sorts, samples, splits, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.functions import maths
from askloom.functions import text as tx
from askloom.operators import retrieve, splits
from askloom.plans import domain as d
from askloom.plans.domain import sql_alnum, sql_content, sql_strip, sql_words, sql_wordchars
from askloom.plans.registry import query, relation
from askloom.sources import stores
from askloom.sources.tables import table
from askloom.util import top_per_group


@query("win_topk_rank", "SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 20")
def win_topk_rank(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return top_per_group(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 20)


@query("win_section_cap", "SELECT doc_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index // 4 ORDER BY chunk_index) AS r FROM chunks) WHERE r <= 2", ("chunks",))
def win_section_cap(spark, sf):
    c = d.chunks(spark, sf).select("doc_id", "chunk_index", F.floor(F.col("chunk_index") / 4).alias("section"))
    return top_per_group(c, ["doc_id", "section"], [F.asc("chunk_index")], 2, "r").select("doc_id", "chunk_index")


relation("sscored", rf"""
    SELECT qa_id, pos, len(list_intersect(list_distinct({sql_content('s')}), list_distinct({sql_content('answer')}))) AS n FROM (
      SELECT qa_id, answer, unnest(ss) AS s, unnest(range(1, len(ss) + 1))::INT AS pos FROM (
        SELECT qa_id, answer, list_filter(list_transform(string_split(regexp_replace(replace(chunk, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: len({sql_words('s')}) >= 5) AS ss FROM qa))""", ("qa",))


@query("win_neighbour_sentences", """
    SELECT qa_id, pos, coalesce(lag(n) OVER w >= 1, false) AS prev_overlaps, coalesce(lead(n) OVER w >= 1, false) AS next_overlaps FROM sscored WINDOW w AS (PARTITION BY qa_id ORDER BY pos)""", ("sscored",))
def win_neighbour_sentences(spark, sf):
    q = d.qa(spark, sf).select("qa_id", tx.canonical_tokens("answer").alias("a"), tx.long_sentences("chunk").alias("ss"))
    s = q.select("qa_id", "a", F.posexplode("ss").alias("pos", "s")).select(
        "qa_id", (F.col("pos") + 1).alias("pos"), F.size(F.array_intersect(tx.canonical_tokens("s"), F.col("a"))).alias("n"))
    w = Window.partitionBy("qa_id").orderBy("pos")
    return s.select("qa_id", "pos", F.coalesce(F.lag("n").over(w) >= 1, F.lit(False)).alias("prev_overlaps"), F.coalesce(F.lead("n").over(w) >= 1, F.lit(False)).alias("next_overlaps"))


@query("win_first_occurrence", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def win_first_occurrence(spark, sf):
    """First row per key, as an aggregate so that a crowded key combines before the shuffle."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query("win_minmax_frame", "SELECT event_id, round(CASE WHEN max(value) OVER u - min(value) OVER u < 1e-12 THEN CASE WHEN max(value) OVER u = 0 THEN 0.0 ELSE 1.0 END ELSE (value - min(value) OVER u) / (max(value) OVER u - min(value) OVER u) END, 6) AS norm FROM events WINDOW u AS (PARTITION BY user_id)")
def win_minmax_frame(spark, sf):
    return retrieve.minmax_rows(table(spark, sf, "events"), "value", "user_id").select("event_id", F.round("norm", 6).alias("norm"))


@query("list_tickets", "SELECT event_id AS ticket_id, user_id AS session_id, ts AS timestamp FROM events WHERE event_type = 'error' ORDER BY ts DESC, user_id")
def list_tickets(spark, sf):
    a = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("ticket_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp"))
    return stores.list_tickets(a).withColumn("ticket_id", F.col("ticket_id").cast("bigint"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100")
def seeded_sample(spark, sf):
    return splits.seeded_sample(d.corpus(spark, sf).select("doc_id"), "doc_id", 100)


def _split(names, ratios) -> str:
    cases, upto = "", []
    for n, r in zip(names[:-1], ratios[:-1]):
        upto.append(f"floor(n * {r}::DOUBLE)")
        cases += f" WHEN p < {' + '.join(upto)} THEN '{n}'"
    return f"CASE{cases} ELSE '{names[-1]}' END"


relation("placed", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents")


@query("split_exact", f"SELECT doc_id, lang, {_split(('train', 'val', 'test'), (0.7, 0.15, 0.15))} AS split FROM placed", ("placed",))
def split_exact(spark, sf):
    return splits.split_exact(d.corpus(spark, sf).select("doc_id", "lang"), "doc_id", "lang")


@query("split_manifest", f"""
    SELECT lang, count_if(s = 'train') AS train, count_if(s = 'val') AS val, count_if(s = 'test') AS test, count(*) AS total, 42 AS seed
    FROM (SELECT lang, {_split(('train', 'val', 'test'), (0.7, 0.15, 0.15))} AS s FROM placed) GROUP BY lang""", ("placed",))
def split_manifest(spark, sf):
    s = splits.split_exact(d.corpus(spark, sf).select("doc_id", "lang"), "doc_id", "lang")
    return splits.split_manifest(s, "lang", 42)


@query("split_90_10", f"SELECT doc_id, {_split(('train', 'val'), (0.9, 0.1))} AS split FROM placed", ("placed",))
def split_90_10(spark, sf):
    return splits.split_exact(d.corpus(spark, sf).select("doc_id", "lang"), "doc_id", "lang", (0.9, 0.1), names=("train", "val")).select("doc_id", "split")


@query("set_union_candidates", """
    SELECT query_id, doc_id, CASE WHEN d.score IS NOT NULL THEN 'dense' ELSE 'sparse' END AS origin
    FROM (SELECT * FROM dense WHERE rank <= 40) d FULL JOIN (SELECT * FROM bm25 WHERE rank <= 40) s USING (query_id, doc_id)""", ("dense", "bm25"))
def set_union_candidates(spark, sf):
    both = d.dense_top(spark, sf, 40).select("query_id", "doc_id", F.lit("dense").alias("origin")).unionByName(d.bm25_top(spark, sf, 40).select("query_id", "doc_id", F.lit("sparse").alias("origin")))
    return both.groupBy("query_id", "doc_id").agg(F.min("origin").alias("origin"))


@query("set_intersect_gold", "SELECT query_id, doc_id FROM bm25 WHERE rank <= 20 INTERSECT SELECT query_id, doc_id FROM gold", ("bm25", "gold"))
def set_intersect_gold(spark, sf):
    return d.bm25_top(spark, sf, 20).select("query_id", "doc_id").intersect(d.gold(spark, sf))


@query("set_diff_gold", "SELECT query_id, doc_id FROM bm25 WHERE rank <= 20 EXCEPT SELECT query_id, doc_id FROM gold", ("bm25", "gold"))
def set_diff_gold(spark, sf):
    return d.bm25_top(spark, sf, 20).select("query_id", "doc_id").exceptAll(d.gold(spark, sf))


@query("ordered_distinct", f"""
    SELECT doc_id, md5(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) AS digest, len(list_distinct(w)) AS n FROM (SELECT doc_id, {sql_alnum('text')} AS w FROM documents)""")
def ordered_distinct(spark, sf):
    u = d.corpus(spark, sf).select("doc_id", F.array_distinct(tx.tokens_alnum("text")).alias("u"))
    return u.select("doc_id", F.md5(F.array_join("u", " ")).alias("digest"), F.size("u").alias("n"))


# ---- scalar functions ------------------------------------------------------------

@query("fn_cosine", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_cosine(spark, sf):
    """Each vector with its successor."""
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(maths.dot("embedding", "other"), 6).alias("cosine"))


# a zero vector stays zero, as in the operator; places are rounded half up in the number's shortest decimal form, as Spark does
@query("fn_l2_normalize", """
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN isfinite(x::DOUBLE * 3 / n) THEN (x::DOUBLE * 3 / n)::VARCHAR::DECIMAL(38, 6)::DOUBLE ELSE x::DOUBLE * 3 / n END) AS unit
    FROM (SELECT vec_id, embedding, sqrt(list_inner_product(list_transform(embedding, lambda y: y::DOUBLE * 3), list_transform(embedding, lambda y: y::DOUBLE * 3))) AS n FROM embeddings)""")
def fn_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    return e.select("vec_id", F.transform(maths.l2_normalize("e"), lambda x: F.round(x, 6)).alias("unit"))


@query("fn_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 10 / 1.5)), 6) AS s, round(ln(least(greatest(value / 100, 1e-6), 1 - 1e-6) / (1 - least(greatest(value / 100, 1e-6), 1 - 1e-6))), 6) AS z FROM events")
def fn_sigmoid(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(maths.sigmoid(F.col("value") / 10, 1.5), 6).alias("s"), F.round(maths.logit(F.col("value") / 100), 6).alias("z"))


@query("fn_log1pexp", "SELECT event_id, round(greatest(value - 10, 0) + ln(1 + exp(-abs(value - 10))), 6) AS y FROM events")
def fn_log1pexp(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(maths.log1p_exp(F.col("value") - 10), 6).alias("y"))


@query("fn_clip", "SELECT event_id, least(greatest(value / 20, 0.4), 0.9) AS y FROM events")
def fn_clip(spark, sf):
    return table(spark, sf, "events").select("event_id", maths.clip(F.col("value") / 20, 0.4, 0.9).alias("y"))


@query("fn_overlap", f"SELECT qa_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END, 6) AS overlap FROM (SELECT qa_id, {sql_wordchars('answer')} AS a, {sql_wordchars('query')} AS b FROM qa)", ("qa",))
def fn_overlap(spark, sf):
    return d.qa(spark, sf).select("qa_id", F.round(maths.overlap(tx.tokens_word("answer"), tx.tokens_word("query")), 6).alias("overlap"))


@query("fn_length_score", f"SELECT doc_id, round(CASE WHEN n < 15 THEN n / 15 WHEN n > 80 THEN greatest(0.0, 1.0 - (n - 80) / 80) ELSE 1.0 END, 6) AS score FROM (SELECT doc_id, len({sql_words('text')}) AS n FROM documents)")
def fn_length_score(spark, sf):
    return d.corpus(spark, sf).select("doc_id", F.round(maths.length_score(tx.word_count("text")), 6).alias("score"))


@query("fn_f1", "SELECT event_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT event_id, greatest(value - 5, 0) / 100 AS p, ((props->>'$.k')::INT // 10) / 10 AS r FROM events)")
def fn_f1(spark, sf):
    p = F.greatest(F.col("value") - 5, F.lit(0.0)) / 100
    r = F.floor(F.get_json_object("props", "$.k").cast("int") / 10) / 10
    return table(spark, sf, "events").select("event_id", F.round(maths.f1(p, r), 6).alias("f1"))


@query("fn_bucket_hash", "SELECT doc_id, (('0x' || substr(sha256(source), 1, 8))::BIGINT % 32) / 32 AS bucket FROM documents")
def fn_bucket_hash(spark, sf):
    return d.corpus(spark, sf).select("doc_id", maths.bucket_hash("source").alias("bucket"))


@query("fn_json_arrays", "SELECT event_id, [event_type, user_id::VARCHAR] AS names, 2 AS n FROM events")
def fn_json_arrays(spark, sf):
    item = lambda c: F.struct(c.alias("name"), F.col("value").alias("v"))
    j = table(spark, sf, "events").select("event_id", F.to_json(F.array(item(F.col("event_type")), item(F.col("user_id").cast("string")))).alias("j"))
    back = F.from_json("j", "array<struct<name:string,v:double>>")
    return j.select("event_id", F.transform(back, lambda x: x["name"]).alias("names"), F.size(back).alias("n"))


@query("fn_grid_map", "SELECT user_id, map_from_entries(list((printf('%.2f', a), s) ORDER BY a)) AS grid FROM (SELECT user_id, (props->>'$.k')::INT // 10 / 10 AS a, count(*) AS s FROM events GROUP BY ALL) GROUP BY user_id")
def fn_grid_map(spark, sf):
    a = F.floor(F.get_json_object("props", "$.k").cast("int") / 10) / 10
    g = table(spark, sf, "events").groupBy("user_id", a.alias("a")).agg(F.count("*").alias("s"))
    rows = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("a", "s"))).alias("r"))
    return rows.select("user_id", F.map_from_entries(F.transform("r", lambda x: F.struct(F.format_string("%.2f", x["a"]), x["s"]))).alias("grid"))


@query("fn_day_cutoff", "SELECT event_id, ts < TIMESTAMP '2024-01-25' - INTERVAL 5 DAY AS is_old FROM events")
def fn_day_cutoff(spark, sf):
    cutoff = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz") - F.make_interval(days=F.lit(5))
    return table(spark, sf, "events").select("event_id", (F.col("ts") < cutoff).alias("is_old"))
