"""Question/answer pairs: chunk selection, validation, evidence, duplicates, cleaning."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import fixed, maths, rules
from askloom.functions import text as tx
from askloom.operators.decompose import first_json_pair
from askloom.operators.likeness import like_pairs
from askloom.util import cut_lineage, global_rank, spread


def select_chunks(chunks: DataFrame, doc: str, section: str, order: str, processed: DataFrame | None = None, key: str = "chunk_id",
                  min_quality: float = 2.5, per_section: int = 2, target: int | None = None, seed: int = 42) -> DataFrame:
    """Adds ``skip_reason`` (null = use the chunk): short, table_like, low_quality, section_saturated, doc_overused.

    The section limit counts the chunks that pass the earlier rules, in order. With a
    ``target`` number of pairs, chunks past a document's fair share are skipped with a
    rising probability (a stable hash coin); without one that clause is off.
    """
    if processed is not None:
        chunks = chunks.join(processed.select(key), key, "left_anti")
    early = (
        F.when(tx.word_count("text") < 30, "short")
        .when(rules.table_like("text"), "table_like")
        .when(rules.chunk_quality("text") < min_quality, "low_quality")
    )
    marked = chunks.withColumn("skip_reason", early)
    ok = F.col("skip_reason").isNull()
    w = Window.partitionBy(doc, section, ok).orderBy(order)
    marked = marked.withColumn("skip_reason", F.when(ok & (F.row_number().over(w) > per_section), "section_saturated").otherwise(F.col("skip_reason")))
    if target is None:
        return marked
    n_docs = chunks.select(doc).distinct().agg(F.count("*").alias("n")).scalar()
    fair = F.greatest(F.lit(4), F.floor(1.8 * target / F.greatest(n_docs, F.lit(1))))
    rn = F.row_number().over(Window.partitionBy(doc, ok).orderBy(order)) - 1
    p = F.when(rn < fair, 0.0).otherwise(F.least(F.lit(0.80), 0.15 + 0.15 * (rn - fair + 1)))
    return marked.withColumn("skip_reason", F.when(ok & (maths.hash_unit(key, seed) < p), "doc_overused").otherwise(F.col("skip_reason")))


def evidence_span(answer, chunk) -> Column:
    """struct(evidence, span_start, span_end): the sentence that shares most words with the answer, with its
    neighbours that share any, 40 to 500 characters, and where it starts in the chunk."""
    answer, chunk = (F.col(c) if isinstance(c, str) else c for c in (answer, chunk))
    tokens = tx.canonical_tokens(answer)

    def place(evidence, first):
        at = F.instr(chunk, first)
        near = F.instr(chunk, F.substring(first, 1, 40))
        start = F.when(at > 0, at - 1).when(near > 0, near - 1).otherwise(0)
        return F.struct(evidence.alias("evidence"), start.alias("span_start"), F.least(start + F.length(evidence), F.length(chunk)).alias("span_end"))

    def trimmed(e):
        cut = F.substring(e, 1, 500)
        last = F.length(F.regexp_extract(cut, r"(?s)^.*[.!?]", 0))
        return F.when(F.length(e) <= 500, e).when(last - 1 > 200, F.substring(cut, F.lit(1), last)).otherwise(cut)

    def pick(ss, scores):
        best = F.array_position(scores, F.array_max(scores)).cast("int")
        at = lambda i: F.get(ss, i - 1)
        linked = lambda i: F.coalesce(F.get(scores, i - 1) >= 1, F.lit(False))
        prev, nxt = (best > 1) & linked(best - 1), linked(best + 1)
        text = F.concat_ws(" ", F.when(prev, at(best - 1)), at(best), F.when(nxt, at(best + 1)))
        padded = F.when(F.length(text) >= 40, text).when(best < F.size(ss), F.concat_ws(" ", text, at(best + 1))).when(
            best > 1, F.concat_ws(" ", at(best - 1), text)).otherwise(text)
        return place(trimmed(padded), F.when(prev, at(best - 1)).otherwise(at(best)))

    def with_sentences(ss):
        no_sentence = F.substring(tx.strip(chunk), 1, 350)
        scored = tx.let(tokens, lambda t: tx.let(F.transform(ss, lambda s: F.size(F.array_intersect(tx.canonical_tokens(s), t))), lambda sc: pick(ss, sc)))
        plain = F.struct(no_sentence.alias("evidence"), F.lit(0).alias("span_start"), F.length(no_sentence).alias("span_end"))
        two = F.array_join(F.slice(ss, 1, 2), " ")
        at = F.greatest(F.instr(chunk, F.get(ss, F.lit(0))) - 1, F.lit(0))
        return F.when(F.size(ss) == 0, plain).when(
            F.size(tokens) == 0, F.struct(two.alias("evidence"), at.alias("span_start"), (at + F.length(two)).alias("span_end"))).otherwise(scored)

    return tx.let(tx.long_sentences(chunk), with_sentences)


def judged(outputs: DataFrame, chunk: str = "text") -> DataFrame:
    """Parse and judge both model outputs of a chunk in one pass; the retry counts only when the first fails.

    Adds query, answer, retried and ``state``: first_ok, retry_ok or skip_invalid.
    """
    out = outputs
    for i, raw in ((1, F.col("raw")), (2, F.when(F.col("r1").isNotNull(), F.col("raw_retry")))):
        out = out.withColumn(f"p{i}", first_json_pair(raw))
        out = out.withColumns({f"q{i}": F.col(f"p{i}.query"), f"a{i}": rules.clean_candidate_answer(F.coalesce(f"p{i}.answer", F.lit("")))})
        out = out.withColumn(f"r{i}", F.when(F.col(f"q{i}").isNull(), "unparsed").otherwise(rules.reject_reason(f"q{i}", f"a{i}", chunk)))
    retried = F.col("r1").isNotNull()
    state = F.when(~retried, "first_ok").when(F.col("r2").isNull(), "retry_ok").otherwise("skip_invalid")
    return out.select(
        *outputs.columns, F.when(retried, F.col("q2")).otherwise(F.col("q1")).alias("query"),
        F.when(retried, F.col("a2")).otherwise(F.col("a1")).alias("answer"), retried.alias("retried"), state.alias("state"))


def build_pairs(outputs: DataFrame, key: str, doc: str, target: int | None = None) -> DataFrame:
    """Question/answer pairs with evidence and markers, from model outputs per chunk (raw, raw_retry).

    Questions with the same canonical form keep the first chunk (by key); the winner per
    form is an aggregate that combines before the shuffle, so a very common question does
    not meet in one task. ``target`` is the number of pairs asked for.
    """
    # The state is tested inside the aggregate: a filter on it would be pushed below the
    # parsing steps and evaluate all of them again for every use.
    ok = F.col("state") != "skip_invalid"
    row = F.struct(key, doc, "text", "query", "answer", "retried")
    forms = judged(outputs).withColumn("canonical", F.when(ok, tx.canonical_string("query")))
    kept = forms.groupBy("canonical").agg(F.min_by(F.when(ok, row), F.when(ok, F.col(key))).alias("w")).filter("w IS NOT NULL").select("w.*")
    if target is not None:
        kept = kept.orderBy(key).limit(target)
    ev = kept.withColumn("_e", evidence_span("answer", "text"))
    marker = F.concat(F.lit(" ["), F.col(doc).cast("string"), F.lit(":"), F.col("_e.span_start").cast("string"), F.lit("-"), F.col("_e.span_end").cast("string"), F.lit("]"))
    return ev.select(
        key, doc, "query", tx.attach_marker(F.col("answer"), marker).alias("answer_with_citations"), F.array(key).alias("gold_chunk_ids"),
        F.col("_e.span_start").alias("span_start"), F.col("_e.span_end").alias("span_end"), F.col("_e.evidence").alias("cited_text"), "retried")


def build_counters(outputs: DataFrame) -> DataFrame:
    """(reason, n): first_ok, retry_ok, skip_invalid and skip_dup.

    Outputs are judged once: states are counted per form inside one aggregate. A filter on the
    state, or a second branch over it, would judge all outputs again.
    """
    states = ("first_ok", "retry_ok", "skip_invalid")
    ok = F.col("state") != "skip_invalid"
    form = F.when(ok, tx.canonical_string("query")).alias("form")
    forms = judged(outputs).select("state", form).groupBy("form").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    sums = forms.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in states], F.count("form").alias("forms"))
    rows = [F.struct(F.lit(s).alias("reason"), F.col(s).alias("n")) for s in states]
    dup = F.struct(F.lit("skip_dup").alias("reason"), (F.col("first_ok") + F.col("retry_ok") - F.col("forms")).alias("n"))
    return sums.select(F.inline(F.array(*rows, dup))).filter((F.col("n") > 0) | (F.col("reason") == "skip_dup"))


# ---- near-duplicate questions ---------------------------------------------------

def keep_first_of_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes kept by keep-first over similar ``pairs`` (earlier, later). Exact; rounds over undecided pairs."""
    live, gone = cut_lineage(pairs), None
    while not live.isEmpty():
        sure = live.select(F.col("earlier").alias("n")).distinct().join(live.select(F.col("later").alias("n")), "n", "left_anti")
        lost = cut_lineage(live.join(sure.withColumnRenamed("n", "earlier"), "earlier", "left_semi").select(F.col("later").alias("n")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        rest = live.join(lost.withColumnRenamed("n", "later"), "later", "left_anti").join(sure.withColumnRenamed("n", "earlier"), "earlier", "left_anti")
        live = cut_lineage(rest.join(lost.withColumnRenamed("n", "earlier"), "earlier", "left_anti"))
    return nodes if gone is None else nodes.join(gone.withColumnRenamed("n", "node"), "node", "left_anti")


#: forms of a block at most, and characters of one
BLOCK_ROWS, BLOCK_CHARS = 16_384, 2 * 1024 * 1024


def form_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later) nodes whose forms can have a ratio above ``threshold``; complete, with few others.

    Forms in order of length become blocks of bounded size; two blocks whose lengths allow a
    pair are a cell, and cells are dealt out evenly. ``likeness.like_pairs`` leaves the pairs
    of a cell whose longest common subsequence is long enough. The pairs looked at grow with the
    square of the forms, memory does not: a task holds the two blocks of a cell.
    """
    n = F.length("form")
    some = nodes.filter(n > 0).select("node", "form", n.alias("n"))
    rows = F.lit(max(2_048, min(BLOCK_ROWS, some.count() // 64)))
    kind = F.floor(F.log2("n"))
    per = F.greatest(F.lit(1), F.least(rows, F.floor(F.lit(BLOCK_CHARS) / F.pow(F.lit(2), kind + 1))))
    placed = global_rank(some, [F.col("n"), F.col("node")]).withColumn("block", kind * F.lit(2**40) + F.floor((F.col("rank") - 1) / per))
    packed = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "node", "form"))).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = cut_lineage(packed)
    a, b = (blocks.select(F.col("block").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high")) for x in "ij")
    reach = 2.0 * F.col("i_high") / (F.col("i_high") + F.col("j_low")) > threshold  # one row per block on either side
    cells = cut_lineage(a.join(b, (F.col("i") == F.col("j")) | ((F.col("i") < F.col("j")) & reach)).select("i", "j"))
    sides = cells.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = spread(sides.join(blocks.select("block", "rows").hint("merge"), "block"), "i", "j")

    def alike(cell: pa.Table) -> pa.Table:
        sides = [pc.list_flatten(cell.sort_by("block").column("rows").slice(k, 1).combine_chunks()) for k in range(cell.num_rows)]
        texts = [s.field("form").to_pylist() for s in sides]
        x, y = like_pairs(texts[0], texts[1] if len(texts) > 1 else None, threshold)
        return pa.table({"x": sides[0].field("node").take(pa.array(x)), "y": sides[-1].field("node").take(pa.array(y))})

    kind = dict(nodes.dtypes)["node"]
    found = dealt.groupBy("i", "j").applyInArrow(alike, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("earlier"), F.greatest("x", "y").alias("later")).filter("earlier < later").distinct()


def question_dedup(questions: DataFrame, key: str, text: str, threshold: float = 0.88) -> DataFrame:
    """(key, kept): a question goes when its canonical form is more than ``threshold`` alike (difflib ratio) to a kept one.

    Equal forms are folded first; only the pairs of ``form_pairs`` are compared in Python.
    """
    forms = questions.select(F.col(key).alias("key"), tx.canonical_string(text).alias("form"))
    nodes = cut_lineage(forms.groupBy("form").agg(F.min("key").alias("node")))
    cand = form_pairs(nodes, threshold)

    @F.pandas_udf("double")
    def ratio(new: pd.Series, old: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(new, old)], dtype="float64")

    s1 = nodes.select(F.col("node").alias("earlier"), F.col("form").alias("f1"))
    s2 = nodes.select(F.col("node").alias("later"), F.col("form").alias("f2"))
    near = cand.join(s1, "earlier").join(s2, "later").filter(ratio("f2", "f1") > threshold).select("earlier", "later")
    kept = keep_first_of_pairs(nodes.select("node"), near).withColumn("kept", F.lit(True))
    return questions.select(F.col(key)).join(kept.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("kept", F.lit(False)).alias("kept"))


# ---- cleaning ---------------------------------------------------------------------

def clean_chain(pairs: DataFrame, key: str, query: str = "query", answer: str = "answer", chunk: str = "chunk", qtype: str = "qtype",
                random_steps: bool = True, seed: int = 42) -> DataFrame:
    """The cleaning rules in their fixed order; adds the cleaned texts and ``drop_reason`` (null = kept)."""
    q, a = tx.strip(query), tx.strip(answer)
    if random_steps:
        q = rules.diversify(q, maths.hash_unit(key, seed), maths.hash_unit(key, seed + 1))
    base = pairs.withColumns({"_q": q, "_a0": a}).withColumn("_a", rules.enrich_answer("_a0", chunk))
    keep = rules.rebalance_keep(qtype, maths.hash_unit(key, seed + 2)) if random_steps else F.lit(True)
    reason = (
        F.when(rules.bad_question("_q"), "bad_question")
        .when(rules.no_answer("_a0"), "no_answer").when(rules.corrupted("_a0"), "corrupted")
        .when(rules.fake_reasoning("_a0"), "fake_reasoning")
        .when(~rules.strictly_grounded("_a", chunk), "not_grounded")
        .when(~rules.complete_answer("_q", "_a"), "incomplete_answer")
        .when(~keep, "rebalanced")
        .when(rules.corrupted("_a"), "corrupted").when(rules.table_answer("_a"), "table_answer")
        .when(~rules.complete("_a"), "incomplete").when(~rules.relevant(rules.fix_typos("_q"), "_a"), "irrelevant")
    )
    return base.withColumns({"drop_reason": reason, "clean_query": rules.fix_typos("_q")}).withColumnRenamed("_a", "clean_answer").drop("_q", "_a0")


def clean_report(cleaned: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("drop_reason").isNull())
    return cleaned.agg(F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("dropped"),
                       F.coalesce(F.try_divide(kept, F.count("*")), F.lit(0.0)).alias("retention"))


# ---- best candidate ----------------------------------------------------------------

def candidate_score(query, answer, chunk, needs_citation: bool = True) -> Column:
    """Grounding + length + question length + citation presence; 0 for an empty question or answer."""
    q, a = tx.strip(query), tx.strip(answer)
    cited = a.rlike(fixed.CITATION_PATTERNS["any_id"])
    score = (
        maths.overlap(tx.tokens_word(a), tx.tokens_word(chunk)) + maths.length_score(tx.word_count(a))
        + F.when(tx.word_count(q).between(4, 40), 1.0).otherwise(0.3)
        + F.when(cited == F.lit(needs_citation), 1.0).otherwise(-0.5))
    return F.when((q == "") | (a == ""), F.lit(0.0)).otherwise(score)


def pick_best(candidates: DataFrame, group: str, pos: str) -> DataFrame:
    """Per group the candidate with the best positive score, the first on ties."""
    live = candidates.filter("score > 0")
    row = F.struct(*[c for c in candidates.columns if c != group])
    return live.groupBy(group).agg(F.max_by(row, F.struct("score", -F.col(pos))).alias("b")).select(group, "b.*")
