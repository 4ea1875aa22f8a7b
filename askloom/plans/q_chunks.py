"""Chunking, deduplication, and the rules over chunks, questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import fixed, maths, rules
from askloom.functions import text as tx
from askloom.operators import chunking, citations, dedup, qa, retrieve
from askloom.plans import domain as d
from askloom.plans.domain import sql_any, sql_content, sql_count, sql_list, sql_sentences, sql_strip, sql_words, sql_wordchars
from askloom.plans.registry import query, relation


@query("chunk_windows", "SELECT doc_id, chunk_index, token_count, md5(text) AS digest FROM chunks", ("chunks",))
def chunk_windows(spark, sf):
    return d.chunks(spark, sf).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


@query("chunk_spans", """
    SELECT doc_id, chunk_index, span_start, span_start + length(c.text) AS span_end, substr(o.text, span_start + 1, length(c.text)) = c.text AS exact
    FROM chunks c JOIN corpus o USING (doc_id)""", ("chunks", "corpus"))
def chunk_spans(spark, sf):
    c = d.chunks(spark, sf).select("doc_id", "chunk_index", "span_start", "span_end", F.col("text").alias("piece"))
    j = c.join(d.corpus(spark, sf).select("doc_id", "text"), "doc_id")
    return j.select("doc_id", "chunk_index", "span_start", "span_end", (F.substring("text", F.col("span_start") + 1, F.length("piece")) == F.col("piece")).alias("exact"))


def _hop(window: str, rx: str) -> str:
    return f"length(regexp_extract({window}, '{rx}'))"


_HEAD, _TAIL = "substr(t, s + 1, 64)", "substr(t, b, e - b + 1)"
_H = [_hop(_HEAD, rf"(?s)^.*?{rx}") for rx in chunking.BREAKS]
_T = [_hop(_TAIL, rx) for rx in (r"(?s)^.+\n{2,}", r"(?s)^.*[.!?]\s+", r"(?s)^.+\n", r"(?s)^.+\s+")]


@query("refine_boundaries", f"""
    SELECT doc_id, chunk_index, r AS refined_start, (CASE {" ".join(f"WHEN {h} > 0 THEN b - 1 + {h}" for h in _T)} ELSE e END)::INT AS refined_end
    FROM (SELECT *, greatest(e - 64, r + 1) AS b FROM (
      SELECT *, (CASE {" ".join(f"WHEN {h} > 0 AND s + {h} < e THEN s + {h}" for h in _H)} ELSE s END)::INT AS r FROM (
        SELECT doc_id, chunk_index, o.text AS t, span_start AS s, span_start + length(c.text) AS e FROM chunks c JOIN corpus o USING (doc_id))))""", ("chunks", "corpus"))
def refine_boundaries(spark, sf):
    spans = d.chunks(spark, sf).select("doc_id", "chunk_index", "span_start", "span_end").join(d.corpus(spark, sf).select("doc_id", "text"), "doc_id")
    return chunking.refine_boundaries(spans).select("doc_id", "chunk_index", "refined_start", "refined_end")


relation("blocks", r"""
    SELECT doc_id, i AS block_idx, b[i] AS text FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1))::INT AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) AS b FROM corpus))""", ("corpus",))


@query("doc_chunk_numbering", r"""
    SELECT doc_id, block_idx, n::INT AS token_count, (row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, i) - 1)::INT AS chunk_index,
           substr(sha256(doc_id || '::chunk::' || (row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, i) - 1)), 1, 16) AS chunk_id
    FROM (SELECT doc_id, block_idx, i, least(40, len(w) - i * 30) AS n FROM (
      SELECT doc_id, block_idx, w, unnest(range(0, CASE WHEN len(w) <= 40 THEN 1 ELSE ceil((len(w) - 40) / 30)::BIGINT + 1 END)) AS i
      FROM (SELECT doc_id, block_idx, regexp_extract_all(text, '\S+\s*') AS w FROM blocks) WHERE len(w) >= 8)) WHERE n >= 8""", ("blocks",))
def doc_chunk_numbering(spark, sf):
    blocks = d.corpus(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text")).withColumn("block_idx", F.col("block_idx") + 1)
    w = chunking.chunk_windows(blocks, ["doc_id", "block_idx"], 40, 10, 8)
    return chunking.number_chunks(w, "doc_id", "block_idx").select("doc_id", "block_idx", "token_count", "chunk_index", "chunk_id")


# Keep-first by brute force: similar pairs, then one pass in key order with the kept list as state.
for _t, _n in ((0.92, "greedy92"), (0.85, "greedy85")):
    relation(f"sh_{_n}", f"""
      SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS h FROM (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents)""")
    relation(f"np_{_n}", f"SELECT doc_id, count(*) AS n FROM sh_{_n} GROUP BY doc_id", (f"sh_{_n}",))
    relation(f"sim_{_n}", f"""
      SELECT a AS earlier, b AS later, c / (x.n + y.n - c) AS jaccard FROM (
        SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM sh_{_n} s JOIN sh_{_n} t ON s.h = t.h AND s.doc_id < t.doc_id GROUP BY ALL)
      JOIN np_{_n} x ON x.doc_id = a JOIN np_{_n} y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {_t}""", (f"sh_{_n}", f"np_{_n}"))
    relation(f"nb_{_n}", f"SELECT later, list(earlier) AS e, row_number() OVER (ORDER BY later) AS i FROM sim_{_n} GROUP BY later", (f"sim_{_n}",))

_GREEDY = """WITH RECURSIVE walk AS (
      SELECT 0::BIGINT AS i, []::BIGINT[] AS gone
      UNION ALL
      SELECT walk.i + 1, CASE WHEN len(list_filter(e, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, later) ELSE gone END
      FROM walk JOIN nb_{n} nb ON nb.i = walk.i + 1),
    lost AS (SELECT unnest(gone) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM walk))
    """


@query("minhash_dedup", _GREEDY.format(n="greedy92") + "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM lost) AS kept FROM documents", ("nb_greedy92",))
def minhash_dedup(spark, sf):
    return dedup.keep_first(d.corpus(spark, sf), "doc_id")


@query("exact_jaccard_pairs", _GREEDY.format(n="greedy85") + """
    SELECT earlier AS kept, later AS dropped, round(jaccard, 6) AS jaccard FROM sim_greedy85
    WHERE earlier NOT IN (SELECT doc_id FROM lost) AND later IN (SELECT doc_id FROM lost)""", ("nb_greedy85", "sim_greedy85"))
def exact_jaccard_pairs(spark, sf):
    pairs = dedup.removal_pairs(d.corpus(spark, sf), "doc_id", threshold=0.85)
    return pairs.select("kept", "dropped", F.round("jaccard", 6).alias("jaccard"))


@query("dedup_stats", _GREEDY.format(n="greedy85") + """
    SELECT count(DISTINCT source) AS docs_seen, count_if(doc_id NOT IN (SELECT doc_id FROM lost)) AS chunks_produced, count_if(doc_id IN (SELECT doc_id FROM lost)) AS dupes_removed FROM documents""", ("nb_greedy85",))
def dedup_stats(spark, sf):
    docs = d.corpus(spark, sf)
    return dedup.dedup_stats(docs, dedup.keep_first(docs, "doc_id", threshold=0.85, exact=True), "doc_id", "source")


def _chars(c: str, ch: str) -> str:
    return f"(length({c}) - length(replace({c}, '{ch}', '')))"


_CODE = f"({sql_count('text', fixed.CODE_MARKERS)} >= 2)"
_LEGAL = f"(len(regexp_extract_all(text, '{fixed.LEGAL_CITE_PATTERN}')) >= 3)"


def sql_table_like(text: str = "text") -> str:
    body = f"""CASE WHEN {sql_strip('text')} = '' THEN true
      WHEN len(regexp_extract_all(lower(text), 'reserved')) > 10 THEN true
      WHEN len(ls) = 0 THEN true
      WHEN len(ls) >= 6 AND len(list_filter(ls, lambda x: {_chars('x', '|')} >= 2)) / len(ls) > 0.6 AND NOT {_CODE} THEN true
      WHEN len(ls) >= 6 AND len(list_filter(ls, lambda x: {_chars('x', chr(9))} >= 2)) / len(ls) > 0.6 THEN true
      WHEN len(ls) >= 8 AND NOT {_CODE} AND len(list_filter(ls, lambda x: len({sql_words('x')}) <= 3)) / len(ls) > 0.75 AND len(regexp_extract_all(text, '[.!?]')) < 3 THEN true
      WHEN length(text) > 300 AND NOT {_CODE} AND NOT {_LEGAL} AND len(regexp_extract_all(text, '[0-9]')) / length(text) > 0.55 THEN true
      WHEN len({sql_words('text')}) > 200 AND len(regexp_extract_all(text, '[.!?]')) = 0 AND NOT {_CODE} AND NOT {_LEGAL} THEN true ELSE false END"""
    return body


relation("lined", f"SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: {sql_strip('x')} <> '') AS ls FROM documents")


@query("code_table_like", f"SELECT doc_id, {_CODE} AS code_like, {sql_table_like()} AS table_like FROM lined", ("lined",))
def code_table_like(spark, sf):
    return d.corpus(spark, sf).select("doc_id", rules.code_like("text").alias("code_like"), rules.table_like("text").alias("table_like"))


def sql_quality(title: str | None = None) -> str:
    trig = " + ".join(f"least(0.2 * {sql_count('text', v)}, 1.0)" for v in fixed.QTYPE_TRIGGERS.values())
    bonus = f" + CASE WHEN length({title}) > 3 THEN 0.5 ELSE 0 END" if title else ""
    wc = f"len({sql_words('text')})"
    ns = f"len(list_filter({sql_sentences('text')}, lambda s: len({sql_words('s')}) >= 5))"
    return rf"""CASE WHEN {wc} < 30 THEN 0.0 ELSE CASE WHEN {wc} BETWEEN 50 AND 500 THEN 2.5 WHEN {wc} < 50 THEN 1.0 ELSE 1.5 END
        + CASE WHEN {ns} >= 4 THEN 2.0 WHEN {ns} >= 2 THEN 1.0 ELSE 0 END + {trig}
        + CASE WHEN regexp_matches(text, '\b\d[\d,\.]*\b') THEN 0.5 ELSE 0 END + CASE WHEN contains(text, '$') OR contains(text, '%') THEN 0.5 ELSE 0 END{bonus} END"""


@query("chunk_quality", f"SELECT doc_id, chunk_index, round(({sql_quality('source')})::DOUBLE, 6) AS quality FROM chunks", ("chunks",))
def chunk_quality(spark, sf):
    return d.chunks(spark, sf).select("doc_id", "chunk_index", F.round(rules.chunk_quality("text", "source"), 6).alias("quality"))


_COIN = "(('0x' || substr(md5(doc_id || '-' || chunk_index || '|{s}'), 1, 8))::BIGINT / 4294967296.0)"
_ORDER = [k for k in fixed.QTYPE_TRIGGERS if k not in ("multi_hop", "comparison")]


@query("choose_qtype", f"""
    SELECT doc_id, chunk_index, CASE WHEN c1 < 0.15 THEN 'multi_hop' WHEN c2 < 0.10 THEN 'comparison' WHEN len(live) = 0 THEN ['policy', 'factoid', 'eligibility'][floor(c3 * 3)::INT + 1]
        WHEN len(live) = 1 THEN live[1].q WHEN c3 * (live[1].s + 0.1 + live[2].s + 0.1) < live[1].s + 0.1 THEN live[1].q ELSE live[2].q END AS qtype
    FROM (SELECT doc_id, chunk_index, {", ".join(_COIN.format(s=i) + f" AS c{i}" for i in (1, 2, 3))},
                 list_filter(list_reverse_sort([{", ".join("{'s': n" + str(i) + " / greatest(top, 1), 'p': -" + str(i) + ", 'q': '" + k + "'}" for i, k in enumerate(_ORDER))}]), lambda x: x.s > 0) AS live
          FROM (SELECT *, greatest({", ".join(f"n{i}" for i in range(len(_ORDER)))}, m1, m2) AS top FROM (
            SELECT doc_id, chunk_index, {", ".join(f"{sql_count('text', fixed.QTYPE_TRIGGERS[k])} AS n{i}" for i, k in enumerate(_ORDER))},
                   {sql_count('text', fixed.QTYPE_TRIGGERS['multi_hop'])} AS m1, {sql_count('text', fixed.QTYPE_TRIGGERS['comparison'])} AS m2 FROM chunks)))""", ("chunks",))
def choose_qtype(spark, sf):
    c = d.chunks(spark, sf).withColumn("key", F.concat_ws("-", "doc_id", "chunk_index"))
    return c.select("doc_id", "chunk_index", rules.choose_qtype("text", *[maths.hash_unit("key", i) for i in (1, 2, 3)]).alias("qtype"))


@query("select_qa_chunks", f"""
    SELECT doc_id, chunk_index, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY doc_id, chunk_index // 4, r IS NULL ORDER BY chunk_index) > 2 THEN 'section_saturated' ELSE r END AS skip_reason
    FROM (SELECT doc_id, chunk_index, CASE WHEN token_count < 30 THEN 'short' WHEN {sql_table_like()} THEN 'table_like' WHEN {sql_quality()} < 2.5 THEN 'low_quality' END AS r
          FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: {sql_strip('x')} <> '') AS ls FROM chunks)
          WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))""", ("chunks",))
def select_qa_chunks(spark, sf):
    from askloom.sources.tables import table
    c = d.chunks(spark, sf).withColumn("section", F.floor(F.col("chunk_index") / 4))
    done = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return qa.select_chunks(c, "doc_id", "section", "chunk_index", done, "doc_id").select("doc_id", "chunk_index", "skip_reason")


def _valid(q="query", a="answer") -> str:
    return rf"""({q} <> '' AND {a} <> '' AND len({sql_words(a)}) >= 8 AND len({sql_words(q)}) >= 5 AND NOT (upper({a}) = {a} AND lower({a}) <> {a})
        AND regexp_matches({a}, '[a-zA-Z]') AND NOT regexp_matches({q}, '\[[^\]]+\]') AND ends_with({q}, '?'))"""


_BG = "list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"
relation("qa_tokens", f"""
    SELECT *, list_filter(cw, lambda w: length(w) > 2) AS cl FROM (SELECT *, {sql_content('answer')} AS awords, {sql_wordchars('chunk')} AS cw FROM qa)""", ("qa",))
_GROUND = f"""CASE WHEN len(awords) = 0 THEN false WHEN len(list_filter(awords, lambda w: list_contains(cw, w))) / len(awords) >= 0.18 THEN true
      WHEN len(awords) < 2 THEN false ELSE len(list_filter({_BG.format(x='awords')}, lambda b: list_contains({_BG.format(x='cl')}, b))) / (len(awords) - 1) >= 0.30 END"""


@query("valid_qa_pair", f"SELECT qa_id, {_valid()} AS valid FROM qa", ("qa",))
def valid_qa_pair(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.valid_pair("query", "answer").alias("valid"))


@query("grounded_18", f"SELECT qa_id, {_GROUND} AS grounded FROM qa_tokens", ("qa_tokens",))
def grounded_18(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.grounded_18("answer", "chunk").alias("grounded"))


_DEPTH = rf"({sql_any('answer', fixed.DEPTH_CONDITIONS)} OR regexp_matches(answer, '\b\d[\d,\.%]*\b') OR {sql_any('answer', fixed.DEPTH_VALUES)})"
_MATH = r"(regexp_matches(answer, '\d+\s*[-+*/]\s*\d+') AND NOT regexp_matches(chunk, '\d+\s*[-+*/]\s*\d+'))"


@query("answer_depth", f"SELECT qa_id, {_DEPTH} AS depth, {sql_any('answer', fixed.FLUFF_PHRASES)} AS fluff, {_MATH} AS inferred_math FROM qa", ("qa",))
def answer_depth(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.answer_depth("answer").alias("depth"), rules.fluff("answer").alias("fluff"), rules.inferred_math("answer", "chunk").alias("inferred_math"))


relation("cleaned_qa", rf"""
    SELECT qa_id, query, chunk, answer, {sql_content('answer')} AS awords, {sql_wordchars('chunk')} AS cw, list_filter({sql_wordchars('chunk')}, lambda w: length(w) > 2) AS cl
    FROM (SELECT qa_id, query, chunk, regexp_replace({sql_strip(r"regexp_replace(answer, '\[[^\]]+\]', '', 'g')")}, '\s+', ' ', 'g') AS answer FROM qa)""", ("qa",))


@query("validate_candidates", f"""
    SELECT qa_id, answer, CASE WHEN NOT {_valid()} THEN 'invalid_pair' WHEN NOT ({_GROUND}) THEN 'grounding' WHEN NOT {_DEPTH} THEN 'no_depth'
        WHEN {sql_any('answer', fixed.FLUFF_PHRASES)} THEN 'fluff' WHEN {_MATH} THEN 'inferred_math' END AS reject_reason FROM cleaned_qa""", ("cleaned_qa",))
def validate_candidates(spark, sf):
    c = d.qa(spark, sf).select("qa_id", "query", "chunk", rules.clean_candidate_answer("answer").alias("answer"))
    return c.select("qa_id", "answer", rules.reject_reason("query", "answer", "chunk").alias("reject_reason"))


def _bad(q="query") -> str:
    return f"({sql_any(q, fixed.BAD_QUESTION_PHRASES)} OR len({sql_words(q)}) < 8 OR starts_with(lower({q}), 'why'))"


def _corrupt(a="answer") -> str:
    return f"(length({sql_strip(a)}) < 8 OR ends_with({a}, '...') OR contains(lower({a}), '{fixed.CORRUPTED_PHRASE}'))"


def _grounded(a="answer", c="chunk") -> str:
    aw = f"list_distinct({sql_wordchars(a)})"
    return f"({c} = '' OR len(list_intersect({aw}, {sql_wordchars(c)})) >= greatest(6, floor(0.5 * len({aw}))))"


def _complete(a="answer") -> str:
    return f"(len({sql_words(a)}) >= 12 AND {sql_any(a, fixed.COMPLETE_WORDS)})"


def _complete_answer(q="query", a="answer") -> str:
    return f"CASE WHEN len({sql_words(a)}) < 12 THEN false WHEN {sql_any(q, fixed.CONDITION_QUESTION_WORDS)} THEN {sql_any(a, fixed.COMPLETE_WORDS)} ELSE true END"


def _relevant(q="query", a="answer") -> str:
    return f"CASE WHEN contains(lower({q}), 'when') THEN {sql_any(a, ('if', 'when', 'must'))} WHEN contains(lower({q}), 'what') THEN len({sql_words(a)}) > 10 ELSE true END"


def _enrich(a="answer", c="chunk") -> str:
    parts = rf"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    hit = f"list_filter({parts}, lambda s: contains(lower(s), lower(substr({a}, 1, 20))))[1]"
    return f"CASE WHEN len({sql_words(a)}) >= 15 OR {c} = '' THEN {a} ELSE coalesce({sql_strip(hit)}, {a}) END"


@query("bad_question", f"SELECT qa_id, {_bad()} AS bad FROM qa", ("qa",))
def bad_question(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.bad_question("query").alias("bad"))


@query("no_answer", rf"""SELECT qa_id, contains(lower(answer), '{fixed.NO_ANSWER_PHRASE}') AS no_answer, {_corrupt()} AS corrupted,
    len(regexp_extract_all(answer, '\d')) > 10 AS table_answer FROM qa""", ("qa",))
def no_answer(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.no_answer("answer").alias("no_answer"), rules.corrupted("answer").alias("corrupted"), rules.table_answer("answer").alias("table_answer"))


@query("strictly_grounded", f"SELECT qa_id, {_grounded()} AS grounded FROM qa", ("qa",))
def strictly_grounded(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.strictly_grounded("answer", "chunk").alias("grounded"))


@query("answer_rules", f"SELECT qa_id, {sql_any('answer', fixed.FAKE_REASONING_PHRASES)} AS fake_reasoning, {_complete()} AS complete, {_complete_answer()} AS complete_answer, {_relevant()} AS relevant FROM qa", ("qa",))
def answer_rules(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.fake_reasoning("answer").alias("fake_reasoning"), rules.complete("answer").alias("complete"),
                                  rules.complete_answer("query", "answer").alias("complete_answer"), rules.relevant("query", "answer").alias("relevant"))


# Short answers for the enrichment rule: the last sentence of the answer, which is inside the chunk for even v.
relation("short_qa", r"SELECT qa_id, chunk, regexp_extract(chunk, '([^ \n]+ [^ \n]+)[ \n]*$', 1) AS answer FROM qa", ("qa",))


@query("enrich_answer", f"SELECT qa_id, {_enrich()} AS answer FROM short_qa", ("short_qa",))
def enrich_answer(spark, sf):
    a = F.regexp_extract("chunk", r"([^ \n]+ [^ \n]+)[ \n]*$", 1)
    return d.qa(spark, sf).select("qa_id", "chunk", a.alias("a")).select("qa_id", rules.enrich_answer("a", "chunk").alias("answer"))


def _coin(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def _diversify(q: str, coin: str, pick: str) -> str:
    cases = " ".join(
        f"WHEN starts_with({q}, '{p}') AND {coin} < 0.5 THEN {sql_list(o)}[floor({pick} * {len(o)})::INT + 1] || substr({q}, {len(p) + 1})" for p, o in fixed.DIVERSIFY_PREFIXES)
    return f"CASE {cases} ELSE {q} END"


def _typos(q: str) -> str:
    for wrong, right in fixed.TYPO_FIXES:
        q = f"replace({q}, '{wrong}', '{right}')"
    return q


@query("diversify_question", f"SELECT qa_id, {_typos(_diversify('query', _coin('qa_id', 42), _coin('qa_id', 43)))} AS query FROM qa", ("qa",))
def diversify_question(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.fix_typos(rules.diversify("query", maths.hash_unit("qa_id", 42), maths.hash_unit("qa_id", 43))).alias("query"))


@query("rebalance_keep", f"SELECT qa_id, {_coin('qa_id', 44)} < CASE qtype WHEN 'eligibility' THEN 0.85 WHEN 'factoid' THEN 0.3 ELSE 1.0 END AS keep FROM qa", ("qa",))
def rebalance_keep(spark, sf):
    return d.qa(spark, sf).select("qa_id", rules.rebalance_keep("qtype", maths.hash_unit("qa_id", 44)).alias("keep"))


relation("clean_qa", f"""
    SELECT qa_id, {_typos('q')} AS clean_query, a AS clean_answer, CASE WHEN {_bad('q')} THEN 'bad_question' WHEN contains(lower(a0), '{fixed.NO_ANSWER_PHRASE}') THEN 'no_answer'
        WHEN {_corrupt('a0')} THEN 'corrupted' WHEN {sql_any('a0', fixed.FAKE_REASONING_PHRASES)} THEN 'fake_reasoning' WHEN NOT {_grounded('a')} THEN 'not_grounded'
        WHEN NOT {_complete_answer('q', 'a')} THEN 'incomplete_answer' WHEN {_corrupt('a')} THEN 'corrupted' WHEN length(regexp_replace(a, '[^0-9]', '', 'g')) > 10 THEN 'table_answer'
        WHEN NOT {_complete('a')} THEN 'incomplete' WHEN NOT {_relevant(_typos('q'), 'a')} THEN 'irrelevant' END AS drop_reason
    FROM (SELECT qa_id, chunk, {sql_strip('query')} AS q, {sql_strip('answer')} AS a0, {_enrich(sql_strip('answer'))} AS a FROM qa)""", ("qa",))


@query("clean_qa_chain", "SELECT qa_id, clean_query, clean_answer, drop_reason FROM clean_qa", ("clean_qa",))
def clean_qa_chain(spark, sf):
    return qa.clean_chain(d.qa(spark, sf), "qa_id", random_steps=False).select("qa_id", "clean_query", "clean_answer", "drop_reason")


@query("clean_qa_report", "SELECT count(*) AS total, count_if(drop_reason IS NULL) AS kept, count_if(drop_reason IS NOT NULL) AS dropped, round(count_if(drop_reason IS NULL) / count(*), 6) AS retention FROM clean_qa", ("clean_qa",))
def clean_qa_report(spark, sf):
    return qa.clean_report(qa.clean_chain(d.qa(spark, sf), "qa_id", random_steps=False)).withColumn("retention", F.round("retention", 6))


def sql_evidence(answer: str, chunk: str, rel: str, keep: str) -> str:
    """Evidence relation: one row per input with evidence, span_start, span_end."""
    return rf"""
    SELECT {keep}, evidence, (CASE WHEN instr(chunk_, f) > 0 THEN instr(chunk_, f) - 1 WHEN instr(chunk_, substr(f, 1, 40)) > 0 THEN instr(chunk_, substr(f, 1, 40)) - 1 ELSE 0 END)::INT AS span_start
    FROM (SELECT *, CASE WHEN length(e) <= 500 THEN e WHEN length(regexp_extract(substr(e, 1, 500), '(?s)^.*[.!?]')) - 1 > 200 THEN regexp_extract(substr(e, 1, 500), '(?s)^.*[.!?]') ELSE substr(e, 1, 500) END AS evidence
      FROM (SELECT *, CASE WHEN length(e0) >= 40 THEN e0 WHEN best < len(ss) THEN e0 || ' ' || ss[best + 1] WHEN best > 1 THEN ss[best - 1] || ' ' || e0 ELSE e0 END AS e
        FROM (SELECT *, CASE WHEN prev THEN ss[best - 1] || ' ' ELSE '' END || ss[best] || CASE WHEN nxt THEN ' ' || ss[best + 1] ELSE '' END AS e0, CASE WHEN prev THEN ss[best - 1] ELSE ss[best] END AS f
          FROM (SELECT *, best > 1 AND sc[best - 1] >= 1 AS prev, best < len(ss) AND sc[best + 1] >= 1 AS nxt
            FROM (SELECT *, list_position(sc, list_max(sc)) AS best
              FROM (SELECT *, list_transform(ss, lambda s: len(list_intersect(list_distinct({sql_content('s')}), at_))) AS sc
                FROM (SELECT *, {chunk} AS chunk_, list_distinct({sql_content(answer)}) AS at_,
                        list_filter(list_transform(string_split(regexp_replace(replace({chunk}, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: len({sql_words('s')}) >= 5) AS ss FROM {rel})))))))
    WHERE len(ss) > 0 AND len(at_) > 0"""


relation("evid", sql_evidence("answer", "chunk", "qa", "qa_id, length(chunk_) AS n"), ("qa",))


@query("evidence_span", r"""
    SELECT qa_id, coalesce(evidence, substr(regexp_replace(chunk, '^\s+|\s+$', '', 'g'), 1, 350)) AS evidence, coalesce(span_start, 0) AS span_start,
           coalesce(least(span_start + length(evidence), n), length(substr(regexp_replace(chunk, '^\s+|\s+$', '', 'g'), 1, 350))) AS span_end FROM qa LEFT JOIN evid USING (qa_id)""", ("qa", "evid"))
def evidence_span(spark, sf):
    return d.qa(spark, sf).select("qa_id", qa.evidence_span("answer", "chunk").alias("e")).select("qa_id", "e.*")


# Model outputs per chunk as a model would return them: some unparsable, some that need the retry.
relation("outs", rf"""
    SELECT doc_id || '-' || chunk_index AS chunk_id, doc_id, text, (doc_id + chunk_index) % 3 AS v,
           'When must ' || array_to_string({sql_words("regexp_replace(text, '[?\\[\\]]', '', 'g')")}[1:9], ' ') || '?' AS query,
           regexp_replace(array_to_string({sql_words("regexp_replace(text, '[\\[\\]{{}}\\\\]', '', 'g')")}[4:40], ' '), '^\s+|\s+$', '', 'g') || ' it is due if 3 days pass.' AS answer FROM chunks""".replace("{{}}", "{}"), ("chunks",))


def outs(spark, sf):
    def upto(c, rx, a, n):
        return F.array_join(F.slice(tx.words(F.regexp_replace(c, rx, "")), a, n), " ")

    o = d.chunks(spark, sf).select(
        F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "text", ((F.col("doc_id") + F.col("chunk_index")) % 3).alias("v"),
        F.concat(F.lit("When must "), upto("text", r"[?\[\]]", 1, 9), F.lit("?")).alias("query"),
        F.concat(tx.strip(upto("text", r"[\[\]{}\\]", 4, 37)), F.lit(" it is due if 3 days pass.")).alias("answer"))
    good = F.to_json(F.struct("query", "answer"))
    return o.select("chunk_id", "doc_id", "text", F.when(F.col("v") == 0, F.lit("sorry")).otherwise(F.concat(F.lit("Here: "), good)).alias("raw"),
                    F.when(F.col("v") == 0, good).otherwise(F.lit("")).alias("raw_retry"))


relation("passed", f"""
    SELECT chunk_id, doc_id, text, query, answer, v = 0 AS retried, array_to_string(list_sort(list_distinct({sql_content('query')})), ' ') AS canonical FROM (
      SELECT *, {sql_content('answer')} AS awords, {sql_wordchars('chunk')} AS cw, list_filter({sql_wordchars('chunk')}, lambda w: length(w) > 2) AS cl
      FROM (SELECT chunk_id, doc_id, text, text AS chunk, v, {sql_strip('query')} AS query, regexp_replace({sql_strip('answer')}, '\\s+', ' ', 'g') AS answer FROM outs))
    WHERE {_valid()} AND ({_GROUND}) AND {_DEPTH} AND NOT {sql_any('answer', fixed.FLUFF_PHRASES)} AND NOT {_MATH} AND NOT contains(query, '{{') AND NOT contains(query, '}}')""", ("outs",))
relation("winners", "SELECT * FROM passed WHERE (canonical, chunk_id) IN (SELECT canonical, min(chunk_id) FROM passed GROUP BY canonical)", ("passed",))
relation("win_evid", sql_evidence("answer", "text", "winners", "chunk_id, doc_id, query, answer, retried, length(chunk_) AS n"), ("winners",))


@query("qa_pairs_build", r"""
    SELECT chunk_id, doc_id, query, retried, evidence AS cited_text, span_start, least(span_start + length(evidence), n) AS span_end, CASE WHEN right(a, 1) IN ('.', '!', '?')
        THEN left(a, length(a) - 1) || ' [' || doc_id || ':' || span_start || '-' || least(span_start + length(evidence), n) || ']' || right(a, 1) END AS answer_with_citations
    FROM (SELECT w.chunk_id, w.doc_id, w.query, w.retried, coalesce(e.evidence, substr(regexp_replace(w.text, '^\s+|\s+$', '', 'g'), 1, 350)) AS evidence, coalesce(e.span_start, 0) AS span_start,
                 length(w.text) AS n, regexp_replace(w.answer, '([.!?])\s+', '\1 ', 'g') AS a FROM winners w LEFT JOIN win_evid e USING (chunk_id))""", ("winners", "win_evid"))
def qa_pairs_build(spark, sf):
    return qa.build_pairs(outs(spark, sf), "chunk_id", "doc_id").drop("gold_chunk_ids")


@query("qa_pairs_counters", """
    SELECT CASE WHEN p.chunk_id IS NULL THEN 'skip_invalid' WHEN retried THEN 'retry_ok' ELSE 'first_ok' END AS reason, count(*) AS n
    FROM outs LEFT JOIN passed p USING (chunk_id) GROUP BY 1
    UNION ALL SELECT 'skip_dup', (SELECT count(*) FROM passed) - (SELECT count(*) FROM winners)""", ("outs", "passed", "winners"))
def qa_pairs_counters(spark, sf):
    return qa.build_counters(outs(spark, sf))


@query("question_dedup")
def question_dedup(spark, sf):
    return qa.question_dedup(d.qa(spark, sf), "qa_id", "query")


@query("pick_best_candidate", rf"""
    SELECT conv_id, arg_max(qa_id, (score, -turn)) AS qa_id, max(score) AS score FROM (
      SELECT conv_id, turn, qa_id, round(CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(a), c)) / len(list_distinct(a)) END
        + CASE WHEN n < 15 THEN n / 15 WHEN n > 80 THEN greatest(0.0, 1.0 - (n - 80) / 80) ELSE 1.0 END + CASE WHEN nq BETWEEN 4 AND 40 THEN 1.0 ELSE 0.3 END
        + CASE WHEN regexp_matches(answer, '\[([^\]:]+):(\d+)-(\d+)\]') THEN 1.0 ELSE -0.5 END, 6) AS score
      FROM (SELECT *, {sql_wordchars('answer')} AS a, {sql_wordchars('chunk')} AS c, len({sql_words('answer')}) AS n, len({sql_words('query')}) AS nq FROM qa))
    WHERE score > 0 GROUP BY conv_id""", ("qa",))
def pick_best_candidate(spark, sf):
    c = d.qa(spark, sf).withColumn("score", F.round(qa.candidate_score("query", "answer", "chunk"), 6)).select("conv_id", "turn", "qa_id", "score")
    return qa.pick_best(c, "conv_id", "turn").select("conv_id", "qa_id", "score")


@query("citation_resolve_check", r"""
    SELECT qa_id, doc_id, s AS span_start, e AS span_end FROM (
      SELECT qa_id, unnest(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]', 1)) AS doc_id, unnest(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]', 2))::INT AS s,
             unnest(regexp_extract_all(answer, '\[([^\]:]+):(\d+)-(\d+)\]', 3))::INT AS e FROM cited)
    WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM documents)""", ("cited",))
def citation_resolve_check(spark, sf):
    from askloom.plans.q_text import cited
    return citations.unresolved(cited(spark, sf), d.corpus(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id")), "qa_id").select("qa_id", "doc_id", "span_start", "span_end")


@query("similarity_floor", """
    SELECT query_id, doc_id, score FROM dense WHERE rank <= 5 AND score >= 0.30 AND doc_id <> query_id
    UNION ALL SELECT query_id, NULL, NULL FROM qv WHERE query_id NOT IN (SELECT query_id FROM dense WHERE rank <= 5 AND score >= 0.30 AND doc_id <> query_id)""", ("dense", "qv"))
def similarity_floor(spark, sf):
    q = d.query_vectors(spark, sf).select("query_id")
    top = d.dense_top(spark, sf, 5).filter("doc_id <> query_id")
    kept, empty = retrieve.similarity_floor(top, q)
    return kept.select("query_id", "doc_id", "score").unionByName(empty.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("score")))


# The same fusion over what a filter on language and source lets through: on both sides, or on the vectors alone.
relation("may", "SELECT doc_id FROM documents WHERE lang = 'en' AND contains(source, '1')")
relation("dense_may", """
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, qv WHERE vec_id IN (SELECT doc_id FROM may))""", ("qv", "may"))
relation("sparse_may", """
    SELECT 'both' AS scope, query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all WHERE score > 0 AND doc_id IN (SELECT doc_id FROM may)
    UNION ALL SELECT 'dense', query_id, doc_id, score, rank FROM bm25""", ("bm25_all", "bm25", "may"))
_NORM = "CASE WHEN max({c}) OVER p - min({c}) OVER p < 1e-12 THEN CASE WHEN max({c}) OVER p = 0 THEN 0.0 ELSE 1.0 END ELSE ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) END"


@query("metadata_filter", f"""
    SELECT scope, query_id, doc_id, score, rank FROM (
      SELECT scope, query_id, doc_id, score, row_number() OVER (PARTITION BY scope, query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT scope, query_id, doc_id, round({fixed.ALPHA_DEFAULT} * dn + (1.0 - {fixed.ALPHA_DEFAULT}) * sn, 6) AS score FROM (
          SELECT scope, query_id, doc_id, {_NORM.format(c="ds")} AS dn, {_NORM.format(c="ss")} AS sn FROM (
            SELECT scope, query_id, doc_id, coalesce(d.score, 0.0) AS ds, coalesce(s.score, 0.0) AS ss
            FROM (SELECT scope, query_id, doc_id, score FROM dense_may, (SELECT unnest(['both', 'dense']) AS scope) WHERE rank <= 20) d
            FULL JOIN (SELECT scope, query_id, doc_id, score FROM sparse_may WHERE rank <= 20) s USING (scope, query_id, doc_id))
          WINDOW p AS (PARTITION BY scope, query_id))))
    WHERE rank <= 10""", ("dense_may", "sparse_may"))
def metadata_filter(spark, sf):
    allowed = d.corpus(spark, sf).filter((F.col("lang") == "en") & F.contains("source", F.lit("1"))).select("doc_id")
    out = None
    for scope in ("both", "dense"):
        top = retrieve.hybrid_fuse(d.queries(spark, sf), d.lexical(spark, sf), d.query_vectors(spark, sf), d.vectors(spark, sf), 10, allowed=allowed, scope=scope)
        part = top.select(F.lit(scope).alias("scope"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out
