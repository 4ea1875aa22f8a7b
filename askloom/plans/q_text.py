"""Text, identifier and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions import text as tx
from askloom.operators import prompts, tools
from askloom.plans import domain as d
from askloom.plans.domain import sql_any, sql_list, sql_strip
from askloom.plans.registry import query, relation
from askloom.sources import records, stores
from askloom.sources.tables import table


def digest(c):
    """Long values are compared by md5, so results stay small; inputs are whole."""
    return F.md5(F.array_join(c, " ") if not isinstance(c, str) else F.col(c))


@query("make_ids", """
    SELECT doc_id, substr(sha256(source || '/' || doc_id), 1, 16) AS doc_key, i AS chunk_index,
           substr(sha256(substr(sha256(source || '/' || doc_id), 1, 16) || '::chunk::' || i), 1, 16) AS chunk_id,
           substr(sha256(text), 1, 16) AS query_hash
    FROM documents, (SELECT unnest([0, 1])::INT AS i)""")
def make_ids(spark, sf):
    docs = d.corpus(spark, sf).withColumn("doc_key", records.doc_id_of(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))))
    return docs.select("doc_id", "doc_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"),
                       records.short_hash("text").alias("query_hash")).withColumn("chunk_id", records.chunk_id_of("doc_key", "chunk_index"))


@query("ticket_id", "SELECT event_id, 'TKT-' || upper(substr(sha256(event_id::VARCHAR), 1, 10)) AS ticket_id FROM events WHERE event_type = 'error'")
def ticket_id(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    return e.select("event_id", records.ticket_id_of(F.col("event_id").cast("string")).alias("ticket_id"))


@query("tokenize_bm25", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM tok", ("tok",))
def tokenize_bm25(spark, sf):
    t = d.corpus(spark, sf).select("doc_id", tx.tokens_bm25("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), digest(F.col("t")).alias("digest"))


@query("tokens_alnum", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {d.sql_alnum('text')} AS t FROM documents)")
def tokens_alnum(spark, sf):
    t = d.corpus(spark, sf).select("doc_id", tx.tokens_alnum("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), digest(F.col("t")).alias("digest"))


@query("canonical_tokens", f"""
    SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, list_sort(list_distinct({d.sql_content('text')})) AS t FROM documents)""")
def canonical_tokens(spark, sf):
    t = d.corpus(spark, sf).select("doc_id", tx.canonical_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), digest(F.col("t")).alias("digest"))


@query("split_sentences", rf"""
    SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(2))) AS digest,
           len(list_filter(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                           lambda x: len({d.sql_words('x')}) >= 5)) AS n_long
    FROM (SELECT doc_id, text, {d.sql_sentences('text')} AS s FROM documents)""")
def split_sentences(spark, sf):
    s = d.corpus(spark, sf).select("doc_id", tx.sentences("text").alias("s"), F.size(tx.long_sentences("text")).alias("n_long"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\x02")).alias("digest"), "n_long")


@query("word_shingles", rf"""
    SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (
      SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
      FROM (SELECT doc_id, {d.sql_words('lower(text)')} AS w FROM documents))""")
def word_shingles(spark, sf):
    s = d.corpus(spark, sf).select("doc_id", tx.word_shingles("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


# Answers with markers in them: conversation answers citing documents by several id forms.
relation("cited", rf"""
    SELECT qa_id, 'As said [' || v || ':0-9] and [' || substr(md5(qa_id), 1, 8) || ':3-40], ' || answer
           || ' [' || substr(md5(qa_id), 1, 8) || ':3-40] [see note] [doc-' || v || '_x:5-7]' AS answer FROM qa""", ("qa",))


def cited(spark, sf):
    h = F.substring(F.md5("qa_id"), 1, 8)
    return d.qa(spark, sf).select("qa_id", "v", F.concat(
        F.lit("As said ["), F.col("v").cast("string"), F.lit(":0-9] and ["), h, F.lit(":3-40], "), "answer", F.lit(" ["), h,
        F.lit(":3-40] [see note] [doc-"), F.col("v").cast("string"), F.lit("_x:5-7]")).alias("answer"))


@query("strip_citations", "SELECT qa_id, " + ", ".join(
    f"""{sql_strip(f"regexp_replace(answer, '{p}', '', 'g')")} AS {n}""" for n, p in fixed.CITATION_PATTERNS.items()) + " FROM cited", ("cited",))
def strip_citations(spark, sf):
    return cited(spark, sf).select("qa_id", *[tx.strip_citations("answer", n).alias(n) for n in fixed.CITATION_PATTERNS])


# Context rows of an answer: three chunks per pair, two of them of the same document.
relation("contexts", """
    SELECT qa_id, substr(md5(qa_id), 1, 8) AS doc_id, 1 AS rank, 0 AS span_start, answer AS text FROM qa
    UNION ALL SELECT qa_id, substr(md5(qa_id), 1, 8), 2, 2, chunk FROM qa
    UNION ALL SELECT qa_id, 'doc-' || v || '_x', 3, 50, query FROM qa""", ("qa",))


def contexts(spark, sf):
    q = d.qa(spark, sf)
    h = F.substring(F.md5("qa_id"), 1, 8)
    rows = F.array(
        F.struct(h.alias("doc_id"), F.lit(1).alias("rank"), F.lit(0).alias("span_start"), F.col("answer").alias("text")),
        F.struct(h.alias("doc_id"), F.lit(2).alias("rank"), F.lit(2).alias("span_start"), F.col("chunk").alias("text")),
        F.struct(F.concat(F.lit("doc-"), F.col("v").cast("string"), F.lit("_x")).alias("doc_id"), F.lit(3).alias("rank"),
                 F.lit(50).alias("span_start"), F.col("query").alias("text")))
    return q.select("qa_id", F.inline(rows))


@query("parse_citations", r"""
    SELECT qa_id, doc_id, s AS span_start, e AS span_end, min(pos)::INT AS pos, any_value(coalesce(
             CASE WHEN text IS NULL THEN '' END,
             nullif(substr(text, greatest(0, s - span_start_) + 1,
                           greatest(greatest(0, s - span_start_), e - span_start_) - greatest(0, s - span_start_)), ''), text)) AS cited_text
    FROM (SELECT m.qa_id, m.doc_id, m.s, m.e, m.pos, c.text, c.span_start AS span_start_
          FROM (SELECT qa_id, unnest(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]', 1)) AS doc_id,
                       unnest(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]', 2))::INT AS s,
                       unnest(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]', 3))::INT AS e,
                       generate_subscripts(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]'), 1) AS pos
                FROM cited) m
          LEFT JOIN (SELECT qa_id, doc_id, arg_max(text, rank) AS text, arg_max(span_start, rank) AS span_start
                     FROM contexts GROUP BY ALL) c ON m.qa_id = c.qa_id AND m.doc_id = c.doc_id)
    GROUP BY qa_id, doc_id, s, e""", ("cited", "contexts"))
def parse_citations(spark, sf):
    from askloom.operators.citations import parse_citations as parse
    return parse(cited(spark, sf), contexts(spark, sf), "qa_id")


@query("cite_text_cap", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1997) || '...' ELSE text END AS cited_text FROM documents")
def cite_text_cap(spark, sf):
    return d.corpus(spark, sf).select("doc_id", tx.capped("text").alias("cited_text"))


relation("history", r"""
    SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS history
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")


@query("assemble_prompt", rf"""
    SELECT qa_id, '<|system|>' || chr(10) || '{prompts.SYSTEM}' || chr(10) || '<|context|>' || chr(10) || ctx || chr(10)
           || history || chr(10) || '<|user|>' || chr(10) || query || chr(10) || '<|assistant|>' || chr(10) AS prompt
    FROM (SELECT qa_id, string_agg('[' || substr(doc_id, 1, 16) || ':' || span_start || '-' || (span_start + length(text)) || '] ' || text,
                                   chr(10) || chr(10) ORDER BY rank) AS ctx FROM contexts GROUP BY qa_id)
    JOIN qa USING (qa_id) JOIN history USING (conv_id)""", ("contexts", "qa", "history"))
def assemble_prompt(spark, sf):
    qa = d.qa(spark, sf)
    ctx = contexts(spark, sf).withColumn("span_end", F.col("span_start") + F.length("text"))
    past = qa.select("qa_id", "conv_id").join(prompts.history_turns(table(spark, sf, "conversations")), "conv_id")
    return prompts.assemble_prompts(ctx, qa.select("qa_id", F.col("query").alias("text")), past, "qa_id")


@query("history_window", "SELECT conv_id, history FROM history", ("history",))
def history_window(spark, sf):
    return prompts.history_turns(table(spark, sf, "conversations"))


@query("format_sft", rf"""
    SELECT qa_id, '<|system|>' || chr(10) || '{prompts.SYSTEM}' || chr(10) || '<|context|>' || chr(10)
           || '[' || substr(md5(qa_id), 1, 16) || ':0-' || length(chunk) || '] ' || chunk || chr(10) || '<|user|>' || chr(10) || query
           || chr(10) || '<|assistant|>' || chr(10) AS prompt,
           {sql_strip(r"regexp_replace(CASE WHEN v % 2 = 0 THEN answer ELSE question_ END, '\[([^\]:]+):(\d+)-(\d+)\]', '', 'g')")} AS response
    FROM (SELECT *, chunk AS question_ FROM qa)""", ("qa",))
def format_sft(spark, sf):
    rec = d.qa(spark, sf).select(
        "qa_id", "query",
        F.array(F.struct(F.lit(None).cast("string").alias("doc_id"), F.md5("qa_id").alias("chunk_id"), F.lit(0).alias("span_start"),
                         F.lit(None).cast("int").alias("span_end"), F.col("chunk").alias("cited_text"))).alias("citations"),
        F.when(F.col("v") % 2 == 0, F.col("answer")).alias("answer_with_citations"),
        F.lit("").alias("answer_without_citations"), F.col("chunk").alias("answer"))
    return prompts.sft_rows(rec)


@query("format_confidence_prompt", """
    SELECT qa_id, 'Use only the context and cite each fact with its [chunk_id:start-end] marker.' || chr(10) || chr(10) || 'CONTEXT:'
           || chr(10) || ctx || chr(10) || chr(10) || 'QUESTION: ' || query || chr(10) || chr(10) || 'ANSWER:' AS prompt
    FROM (SELECT qa_id, string_agg('[' || doc_id || ':' || span_start || '-' || (span_start + length(text)) || ']' || chr(10) || text,
                                   chr(10) || chr(10) ORDER BY rank) AS ctx FROM contexts GROUP BY qa_id)
    JOIN qa USING (qa_id)""", ("contexts", "qa"))
def format_confidence_prompt(spark, sf):
    ctx = contexts(spark, sf).withColumn("span_end", F.col("span_start") + F.length("text")).withColumnRenamed("doc_id", "chunk_id")
    return prompts.confidence_prompts(ctx, d.qa(spark, sf).select("qa_id", F.col("query").alias("text")), "qa_id")


_FRAME = f"floor(('0x' || substr(md5(id || '|42'), 1, 8))::BIGINT / 4294967296.0 * {len(prompts.FRAME_ASKS)})::INT"


@query("format_qa_prompt", f"""
    WITH c AS (SELECT doc_id || '-' || chunk_index AS id, text FROM chunks),
      k AS (SELECT id, text, retry, CASE WHEN retry THEN '{fixed.QTYPE_ALTERNATE.get("factoid", "policy")}' ELSE 'factoid' END AS qtype FROM c, (SELECT unnest([false, true]) AS retry))
    SELECT id AS chunk_id, qtype, {_FRAME} AS frame, retry, 'PASSAGE:' || chr(10) || text || chr(10) || chr(10) || 'QUESTION TYPE: ' || upper(qtype) || chr(10) || 'ASK ABOUT: '
      || {sql_list(prompts.FRAME_ASKS)}[{_FRAME} + 1] || chr(10) || chr(10) || 'Reply with strict JSON: {{"query": "...", "answer": "..."}}' AS prompt FROM k""", ("chunks",))
def format_qa_prompt(spark, sf):
    """Prompts for every chunk and their retry form."""
    c = d.chunks(spark, sf).select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "text", F.lit("factoid").alias("kind"))
    first = prompts.qa_prompts(c, "chunk_id", "kind").withColumn("retry", F.lit(False))
    return first.unionByName(prompts.qa_prompts(c, "chunk_id", "kind", retry=True).withColumn("retry", F.lit(True)))


relation("raw_out", rf"""
    SELECT qa_id, v, query, answer, CASE v WHEN 0 THEN answer || '<|end|> more ' || query
                WHEN 1 THEN answer || chr(10) || chr(10) || 'Note: ' || query || '<|user|>'
                WHEN 2 THEN answer || ' >|Human|' || answer
                WHEN 3 THEN answer || chr(10) || 'User: ' || query ELSE answer END AS raw FROM qa""", ("qa",))
_STOPS = "|".join(__import__("re").sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s) for s in fixed.STOP_STRINGS)


@query("truncate_at_stop", f"""SELECT qa_id, {sql_strip(f"regexp_replace(raw, '(?s)({_STOPS}).*$', '')")} AS text FROM raw_out""", ("raw_out",))
def truncate_at_stop(spark, sf):
    v, nl = F.col("v"), F.lit("\n")
    raw = (F.when(v == 0, F.concat("answer", F.lit("<|end|> more "), "query"))
           .when(v == 1, F.concat("answer", F.lit("\n\nNote: "), "query", F.lit("<|user|>")))
           .when(v == 2, F.concat("answer", F.lit(" >|Human|"), "answer"))
           .when(v == 3, F.concat("answer", nl, F.lit("User: "), "query")).otherwise(F.col("answer")))
    return d.qa(spark, sf).select("qa_id", tx.truncate_at_stop(raw).alias("text"))


@query("attach_marker", rf"""
    SELECT qa_id, CASE WHEN right(t, 1) IN ('.', '!', '?') THEN left(t, length(t) - 1) || m || right(t, 1) ELSE t || m END AS answer
    FROM (SELECT qa_id, ' [' || qa_id || ':0-9]' AS m, regexp_replace({sql_strip('answer')}, '([.!?])\s+', '\1 ', 'g') AS t FROM qa)""", ("qa",))
def attach_marker(spark, sf):
    return d.qa(spark, sf).select("qa_id", tx.attach_marker(F.col("answer"), F.concat(F.lit(" ["), "qa_id", F.lit(":0-9]"))).alias("answer"))


@query("extract_json_output", """
    SELECT qa_id, query, answer, subs FROM (
      SELECT qa_id, CASE WHEN v IN (0, 1, 3, 5) THEN query END AS query, CASE WHEN v IN (0, 1, 3, 5) THEN trim(regexp_replace(answer, '[{}]', '', 'g'), chr(10) || ' ') END AS answer,
             CASE WHEN v IN (0, 3) THEN [query, 'two'] END AS subs FROM qa)""", ("qa",))
def extract_json_output(spark, sf):
    from askloom.operators.decompose import first_json_pair, first_json_strings
    v = F.col("v")
    body = F.to_json(F.struct("query", F.regexp_replace("answer", "[{}]", "").alias("answer")))
    raw = (F.when(v.isin(0, 3), F.concat(F.lit("Sure: "), body, F.lit(" done {"))).when(v == 1, F.concat(F.lit("{bad} "), body, body))
           .when(v == 5, F.concat(F.lit("{}"), body)).otherwise(F.concat(F.lit("no json "), "query")))
    arr = F.when(v.isin(0, 3), F.concat(F.lit("[1, 2] list: "), F.to_json(F.array("query", F.lit("two"))))).otherwise(F.lit("[oops"))
    p = first_json_pair(F.col("raw"))
    return d.qa(spark, sf).select("qa_id", raw.alias("raw"), arr.alias("arr")).select("qa_id", p.alias("p"), first_json_strings("arr").alias("subs")).select(
        "qa_id", "p.query", "p.answer", "subs")


# Small talk: conversation texts and the short phrases people open and close with.
SMALL = ("hey there!", "Thanks a lot", "bye", "ok", "how do I reset it", "Got it.", "see you later!", "  ")
relation("talk", f"""
    SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 2 = 0 THEN {sql_list(SMALL)}[(conv_id % 8) + 1] ELSE text END AS message FROM conversations""")


@query("chitchat_class", rf"""
    SELECT conv_id, turn, CASE WHEN s = '' OR regexp_matches(s, '(?i){fixed.REAL_QUESTION.replace("'", "''")}') THEN NULL
      {" ".join(rf"WHEN regexp_matches(s, '(?i)^\s*{p.replace(chr(39), chr(39) * 2)}[\s!?.]*$') THEN '{n}'" for n, p in fixed.SMALL_TALK.items())} END AS kind
    FROM (SELECT conv_id, turn, {sql_strip('message')} AS s FROM talk)""", ("talk",))
def chitchat_class(spark, sf):
    m = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.get(F.array(*[F.lit(s) for s in SMALL]), (F.col("conv_id") % 8).cast("int"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.small_talk_class(m).alias("kind"))


@query("out_of_scope_flag", f"""
    SELECT qa_id, {sql_any('reply', fixed.OUT_OF_SCOPE_PHRASES)} AS out_of_scope FROM (
      SELECT qa_id, CASE WHEN v IN (1, 4) THEN answer || ' This is Not Mentioned In the text.' ELSE answer END AS reply FROM qa)""", ("qa",))
def out_of_scope_flag(spark, sf):
    reply = F.when(F.col("v").isin(1, 4), F.concat("answer", F.lit(" This is Not Mentioned In the text."))).otherwise(F.col("answer"))
    return d.qa(spark, sf).select("qa_id", tx.any_phrase(reply, fixed.OUT_OF_SCOPE_PHRASES).alias("out_of_scope"))


@query("refine_query", rf"""
    SELECT query_id, it AS iteration, text || chr(10) || {sql_list(fixed.REFINE_HINTS)}[least(it, 2) + 1]
           || CASE WHEN len(t) > 0 THEN chr(10) || 'Exclude: ' || array_to_string(t[1:5], '; ') ELSE '' END AS refined
    FROM (SELECT query_id, it, text, list_sort(list_distinct(coalesce(topics, []))) AS t
          FROM q CROSS JOIN (SELECT unnest([0, 1, 2, 3])::INT AS it)
          LEFT JOIN (SELECT query_id, list(source) AS topics FROM bm25 JOIN corpus USING (doc_id) WHERE rank <= 10 GROUP BY query_id) USING (query_id))""",
       ("q", "bm25", "corpus"))
def refine_query(spark, sf):
    q, docs = d.queries(spark, sf), d.corpus(spark, sf).select("doc_id", "source")
    from askloom.util import broadcast_if
    top = docs.join(broadcast_if(d.bm25_top(spark, sf, 10), q, 10), "doc_id").groupBy("query_id").agg(F.collect_set("source").alias("topics"))
    it = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("iteration")
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    return q.join(top, "query_id", "left").select("query_id", "text", "topics", it).select(
        "query_id", "iteration", tx.refine_query("text", topics, "iteration").alias("refined"))


# Multi-part questions: two questions of a conversation joined in several ways.
JOINS = (" and also ", "? ", " and ", " additionally, ", " besides ", ". ", " or ")
relation("asked", f"""
    SELECT conv_id, turn, v, a || {sql_list(JOINS)}[v + 1] || b || CASE WHEN v % 2 = 0 THEN '?' ELSE '.' END AS text FROM (
      SELECT conv_id, turn, v, regexp_replace(question, '[.!? ]+$', '') AS a, regexp_replace(regexp_replace(answer, '\\n[^§]*$', ''), '[.!? ]+$', '') AS b
      FROM (SELECT *, ((conv_id * 3 + turn) % 7)::INT AS v FROM turns))""", ("turns",))


def asked(spark, sf):
    t = d.turns(spark, sf).withColumn("v", ((F.col("conv_id") * 3 + F.col("turn")) % 7).cast("int"))
    a = F.regexp_replace("question", "[.!? ]+$", "")
    b = F.regexp_replace(F.regexp_replace("answer", "\\n[^§]*$", ""), "[.!? ]+$", "")
    return t.select("conv_id", "turn", "v", F.concat(
        a, F.get(F.array(*[F.lit(j) for j in JOINS]), F.col("v")), b, F.when(F.col("v") % 2 == 0, "?").otherwise(".")).alias("text"))


_SEP = "(?i)(?:" + "|".join(fixed.SPLIT_SEPARATORS) + ")"
relation("parts", rf"""
    SELECT conv_id, turn, v, text, list_filter(list_transform(string_split_regex(text, '{_SEP}'), lambda p: {sql_strip('p')}), lambda p: p <> '') AS p,
           length(text) - length(replace(text, '?', '')) AS marks FROM asked""", ("asked",))


@query("multi_part_flag", rf"""
    SELECT conv_id, turn, marks > 1 OR len(p) > 1 AS by_split, marks >= 2 OR regexp_matches(text, '(?i){fixed.CONJUNCTION}') AS by_word FROM parts""", ("parts",))
def multi_part_flag(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", tx.multi_part_by_split("text").alias("by_split"), tx.multi_part_by_word("text").alias("by_word"))


relation("subs", rf"""
    SELECT conv_id, turn, v, text, CASE WHEN len(k) = 0 THEN [{sql_strip('text')}] ELSE k[1:5] END AS subs FROM (
      SELECT conv_id, turn, v, text, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN list_position(list_transform(r, lambda y: lower(y)), lower(r[i])) = i THEN r[i] END), lambda y: y IS NOT NULL) AS k
      FROM (SELECT conv_id, turn, v, text, list_filter(list_transform(range(1, len(p) + 1), lambda i: {sql_strip(r"regexp_replace(CASE WHEN i < len(p) AND NOT ends_with(p[i], '?') THEN regexp_replace(p[i], '\.+$', '') || '?' ELSE p[i] END, '^[-*]+|[-*]+$', '', 'g')")}), lambda y: y <> '') AS r FROM parts))""", ("parts",))


@query("split_sub_queries", "SELECT conv_id, turn, pos::INT AS pos, subs[pos] AS sub_query FROM (SELECT conv_id, turn, subs, unnest(range(1, len(subs) + 1)) AS pos FROM subs)", ("subs",))
def split_sub_queries(spark, sf):
    s = asked(spark, sf).select("conv_id", "turn", F.posexplode(tx.split_sub_queries("text")).alias("pos", "sub_query"))
    return s.withColumn("pos", F.col("pos") + 1)


@query("tool_args_validate", """
    SELECT event_id, tool, list_sort(list_filter([
      CASE WHEN tool = 'Nope' THEN 'unknown_tool' END,
      CASE WHEN tool = 'SearchKB' AND k % 4 = 0 THEN 'missing:query' END,
      CASE WHEN tool = 'SearchKB' AND k % 4 = 1 THEN 'type:query' END,
      CASE WHEN tool = 'SearchKB' AND k > 50 THEN 'maximum:top_k' END,
      CASE WHEN tool = 'SearchKB' AND k < 1 THEN 'minimum:top_k' END,
      CASE WHEN tool = 'GetPolicy' AND k % 3 = 0 THEN 'type:fuzzy' END,
      CASE WHEN tool = 'GetPolicy' AND k % 3 = 1 THEN 'unknown:extra' END,
      CASE WHEN tool = 'CreateTicket' AND k % 2 = 0 THEN 'enum:category' END,
      CASE WHEN tool = 'CreateTicket' AND k % 5 = 0 THEN 'missing:severity' END,
      CASE WHEN tool = 'AnswerVerify' AND k % 2 = 0 THEN 'type:cited_spans' END,
      CASE WHEN tool = 'AnswerVerify' AND k % 3 = 0 THEN 'type:confidence' END], lambda e: e IS NOT NULL)) AS errors
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'SearchKB' WHEN 'click' THEN 'GetPolicy' WHEN 'signup' THEN 'CreateTicket'
                                WHEN 'purchase' THEN 'AnswerVerify' ELSE 'Nope' END AS tool, (props->>'$.k')::INT AS k FROM events)""")
def tool_args_validate(spark, sf):
    k, ty = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    tool = F.when(ty == "view", "SearchKB").when(ty == "click", "GetPolicy").when(ty == "signup", "CreateTicket").when(ty == "purchase", "AnswerVerify").otherwise("Nope")
    args = (
        F.when(ty == "view", F.concat(F.when(k % 4 == 0, "{").when(k % 4 == 1, '{"query": 7, ').otherwise('{"query": "x y", '), F.lit('"top_k": '), k.cast("string"), F.lit("}")))
        .when(ty == "click", F.concat(F.lit('{"section_id": "s1", "fuzzy": '), F.when(k % 3 == 0, '"yes"}').when(k % 3 == 1, 'true, "extra": 1}').otherwise("false}")))
        .when(ty == "signup", F.concat(F.lit('{"category": '), F.when(k % 2 == 0, '"misc"').otherwise('"billing"'), F.when(k % 5 == 0, "}").otherwise(', "severity": "high"}')))
        .otherwise(F.concat(F.lit('{"answer": "a", "cited_spans": '), F.when(k % 2 == 0, '"none"').otherwise("[]"), F.lit(', "confidence": '), F.when(k % 3 == 0, '"high"').when(k % 3 == 1, "1").otherwise("0.5"), F.lit("}"))))
    return table(spark, sf, "events").select("event_id", tool.alias("tool"), args.alias("args")).select(
        "event_id", "tool", tools.tool_arg_errors("tool", "args").alias("errors"))


@query("severity_sla", """
    SELECT o_orderkey, CASE sev WHEN 'critical' THEN '2h' WHEN 'high' THEN '8h' WHEN 'low' THEN '72h' ELSE '24h' END AS sla,
           CASE WHEN sev IN ('critical', 'high', 'medium', 'low') THEN sev ELSE 'medium' END AS severity,
           CASE WHEN o_orderstatus = 'P' THEN 'policy' WHEN o_orderstatus = 'F' THEN 'billing' ELSE 'other' END AS category
    FROM (SELECT o_orderkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' ELSE lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) END AS sev FROM orders)""")
def severity_sla(spark, sf):
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise(F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")))
    cat = F.when(F.col("o_orderstatus") == "P", "policy").when(F.col("o_orderstatus") == "F", "billing").otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", stores.severity_sla(sev).alias("sla"), stores.valid_severity(sev).alias("severity"), stores.valid_category(cat).alias("category"))
