"""Answer metrics as Column expressions over one row per response (arrays for ids, citations, calls)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.functions.stem import porter


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


# ---- grounding --------------------------------------------------------------------

def split_by(tokens: Column, known: Column) -> Column:
    """struct(n, rest): how many ``tokens`` are in ``known``, and the others; one sort, no nested scans."""
    tagged = F.array_sort(F.concat(
        F.transform(F.array_distinct(known), lambda t: F.struct(t.alias("t"), F.lit(0).alias("own"))),
        F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(1).alias("own")))))
    hit = lambda r: r["head"]["own"] == 0
    return tx.let(tx.runs(tagged, lambda x: x["t"]), lambda runs: F.struct(
        F.aggregate(F.filter(runs, hit), F.lit(0), lambda s, r: s + r["n"] - 1).alias("n"),
        F.flatten(F.transform(F.filter(runs, lambda r: ~hit(r)), lambda r: F.array_repeat(r["head"]["t"], r["n"]))).alias("rest")))


def grounding(answer, support) -> Column:
    """Mean credit of the answer's content tokens: 1 when in the support text, 0.6 when a 5-letter prefix is."""
    at = F.filter(tx.tokens_alnum(answer), lambda t: ~t.isin(*fixed.GROUNDING_STOPWORDS))
    prefixes = lambda s: F.transform(F.filter(s, lambda t: F.length(t) >= 5), lambda t: F.left(t, F.lit(5)))

    def credit(a, s):
        whole = lambda w: tx.let(split_by(prefixes(w["rest"]), prefixes(s)), lambda h: w["n"] + 0.6 * h["n"])
        return F.when((F.size(a) == 0) | (F.size(s) == 0), F.lit(0.0)).otherwise(tx.let(split_by(a, s), whole) / F.size(a))

    return tx.let(at, lambda a: tx.let(tx.tokens_alnum(support), lambda s: credit(a, s)))


# ---- ROUGE --------------------------------------------------------------------------

def numbered(tokens) -> Column:
    """The tokens with the number of their occurrence attached, so that a multiset becomes a set."""
    each = lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda k: F.concat_ws("\x00", r["head"], k.cast("string")))
    return F.flatten(F.transform(tx.runs(F.array_sort(_c(tokens))), each))


def clipped_matches(a, b) -> Column:
    """Size of the multiset intersection of two token arrays; linear but for the sort."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def rouge_n(prediction_tokens, target_tokens, n: int) -> Column:
    """struct(precision, recall, f1) of n-gram overlap with clipped counts."""
    def score(p, t):
        m = clipped_matches(t, p)
        return F.struct(share(m, F.size(p)).alias("precision"), share(m, F.size(t)).alias("recall"),
                        share(2 * m, F.size(p) + F.size(t)).alias("f1"))

    return tx.let(tx.ngrams(_c(prediction_tokens), n), lambda p: tx.let(tx.ngrams(_c(target_tokens), n), lambda t: score(p, t)))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays (bit-parallel, exact)."""
    def one(x, y) -> int:
        if x is None or y is None or not len(x) or not len(y):
            return 0
        places: dict[str, int] = {}
        for i, t in enumerate(x):
            places[t] = places.get(t, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for t in y:
            hit = row & places.get(t, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - bin(row).count("1")

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(prediction_tokens, target_tokens) -> dict[str, Column]:
    p, t = _c(prediction_tokens), _c(target_tokens)
    m = lcs_length(t, p)
    return {"precision": share(m, F.size(p)), "recall": share(m, F.size(t)), "f1": share(2 * m, F.size(p) + F.size(t))}


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Porter stems of tokens longer than three letters; words seen once per worker are remembered."""
    known: dict[str, str] = {}

    def stem(t: str) -> str:
        if len(t) <= 3:
            return t
        if t not in known:
            if len(known) > 200_000:
                known.clear()
            known[t] = porter(t)
        return known[t]

    for tokens in batches:
        yield pd.Series([None if ts is None else [stem(t) for t in ts] for ts in tokens])


# ---- citations ------------------------------------------------------------------------

def citation_scores(predicted, gold) -> Column:
    """struct(precision, recall, f1) of citations, matched greedily in prediction order.

    Each gold span is used once. IoU >= 0.5 counts 1, any overlap 0.5, the same document
    0.25; an empty predicted span counts as full overlap. Both empty is 1. Arrays of
    struct(doc_id, span_start, span_end); their sizes are those of one response.
    """
    def iou(p, g):
        return F.when(p["span_start"] >= p["span_end"], F.lit(1.0)).otherwise(maths.span_iou(p["span_start"], p["span_end"], g["span_start"], g["span_end"]))

    def step(golds):
        def fold(state, p):
            open_ = F.filter(F.transform(golds, lambda g, i: F.struct(
                F.when((g["doc_id"] == p["doc_id"]) & ~F.array_contains(state["used"], i), iou(p, g)).alias("ov"), (-i).alias("at"))), lambda x: x["ov"].isNotNull())
            return tx.let(F.array_max(open_), lambda b: F.struct(
                F.when(b.isNull(), state["used"]).otherwise(F.array_append(state["used"], -b["at"])).alias("used"),
                (state["tp"] + F.when(b.isNull(), 0.0).when(b["ov"] >= 0.5, 1.0).when(b["ov"] > 0, 0.5).otherwise(0.25)).alias("tp")))
        return fold

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("tp"))

    def score(ps, gs):
        tp = F.aggregate(ps, start, step(gs), lambda s: s["tp"])
        return tx.let(tp, lambda t: F.struct(
            share(t, F.size(ps)).alias("precision"), share(t, F.size(gs)).alias("recall"),
            maths.f1(share(t, F.size(ps)), share(t, F.size(gs))).alias("f1")))

    one = F.struct(F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("f1"))
    return tx.let(_c(predicted), lambda ps: tx.let(_c(gold), lambda gs: F.when((F.size(ps) == 0) & (F.size(gs) == 0), one).otherwise(score(ps, gs))))


# A capitalised ASCII word with no word character (of any script) on either side.
PROPER = r"(^|[^\p{L}\p{N}_])[A-Z][a-zA-Z0-9]+($|[^\p{L}\p{N}_])"


def factual(sentence) -> Column:
    """A digit, or a capitalised word after the first token."""
    s = tx.strip(sentence)
    tail = F.regexp_extract(s, r"(?s)^\S+\s+(.*)$", 1)
    return s.rlike(r"\d") | tail.rlike(PROPER)


def citation_coverage(answer, citations, gold_docs) -> Column:
    """Share of factual sentences that share a token with a citation of a gold document.

    No factual sentence gives 1, no valid citation 0; a valid citation without text covers
    everything. ``citations``: array of struct(doc_id, cited_text).
    """
    facts = F.filter(tx.sentences(answer), factual)
    valid = F.filter(_c(citations), lambda c: F.array_contains(_c(gold_docs), c["doc_id"]))
    sets = F.transform(valid, lambda c: F.array_distinct(tx.tokens_alnum(F.coalesce(c["cited_text"], F.lit("")))))

    def covered(s, vs):
        return tx.let(tx.tokens_alnum(s), lambda t: (F.size(t) == 0) | F.exists(vs, lambda v: (F.size(v) == 0) | F.arrays_overlap(v, t)))

    def score(fs, vs):
        hit = F.size(F.filter(fs, lambda s: covered(s, vs)))
        return F.when(F.size(fs) == 0, F.lit(1.0)).when(F.size(vs) == 0, F.lit(0.0)).otherwise(hit / F.size(fs))

    return F.when(_c(answer) == "", F.lit(0.0)).otherwise(tx.let(facts, lambda fs: tx.let(sets, lambda vs: score(fs, vs))))


# ---- tools, escalation, completeness, composite ---------------------------------------

def tool_appropriateness(used, needed) -> Column:
    """1 right, 0.5 an unneeded outside tool, 0 the needed tool missing."""
    used, needed = _c(used), _c(needed)
    outside = F.size(F.array_except(used, F.array(*[F.lit(t) for t in fixed.INTERNAL_TOOLS])))
    return F.when(needed.isNull(), F.when(outside == 0, 1.0).otherwise(0.5)).otherwise(F.when(F.array_contains(used, needed), 1.0).otherwise(0.0))


def tool_name_match(used, gold) -> Column:
    return F.when(F.coalesce(_c(gold), F.lit("")) == "", 1.0).otherwise(F.when(F.array_contains(_c(used), _c(gold)), 1.0).otherwise(0.0))


def arg_f1(predicted, gold) -> Column:
    """F1 over (key, trimmed lower-case value) pairs of two string maps."""
    norm = lambda m: F.transform(F.map_entries(_c(m)), lambda e: F.concat(e["key"], F.lit("="), F.lower(tx.strip(e["value"]))))
    return tx.let(norm(predicted), lambda p: tx.let(norm(gold), lambda g: F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).otherwise(
        share(2 * F.size(F.array_intersect(p, g)), F.size(p) + F.size(g)))))


def escalation_accuracy(ticket, should) -> Column:
    return F.when(_c(ticket).isNotNull() == _c(should), 1.0).otherwise(0.0)


def completeness(answer, key_points) -> Column:
    """Mean similarity (ROUGE-1 F1 by default) of the answer to each key point; none gives 1."""
    def mean(a, ks):
        total = F.aggregate(F.transform(ks, lambda k: rouge_n(a, tx.tokens_alnum(k), 1)["f1"]), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(ks) == 0, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(total / F.size(ks))

    return tx.let(tx.tokens_alnum(answer), lambda a: tx.let(_c(key_points), lambda ks: mean(a, ks)))


def fcrs(complete, coverage, tool, escalation, needed, should) -> Column:
    """Weighted composite over the parts that can be judged: tool only with a needed tool, escalation only when due."""
    w = fixed.FCRS_WEIGHTS
    parts = (
        (_c(complete), F.lit(w["completeness"])), (_c(coverage), F.lit(w["citation_coverage"])),
        (_c(tool), F.when(_c(needed).isNotNull(), w["tool_appropriateness"]).otherwise(0.0)),
        (_c(escalation), F.when(_c(should), w["escalation_accuracy"]).otherwise(0.0)))
    return F.try_divide(sum((s * x for s, x in parts), F.lit(0.0)), sum((x for _, x in parts), F.lit(0.0)))


def recall_with_fallback(chunk_ids, citation_ids, doc_ids, gold_ids, gold_docs, k: int = 20) -> Column:
    """Recall from retrieved chunks, else from cited chunks when any is gold, else from documents, else null."""
    r, c, dd, g, gd = map(_c, (chunk_ids, citation_ids, doc_ids, gold_ids, gold_docs))
    by_doc = F.when(F.size(gd) > 0, maths.recall(dd, gd, k))
    return (
        F.when(F.size(g) == 0, by_doc).when(F.size(r) > 0, maths.recall(r, g, k))
        .when(F.arrays_overlap(c, g), maths.recall(c, g, k)).otherwise(by_doc))
