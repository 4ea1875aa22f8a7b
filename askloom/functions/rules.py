"""Rules over chunks, questions and answers as Boolean and score Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions import text as tx


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- chunks ---------------------------------------------------------------

def code_like(c) -> Column:
    return tx.count_phrases(c, fixed.CODE_MARKERS) >= 2


def table_like(c) -> Column:
    """Does the text look like a table or a list rather than prose?"""
    t = _col(c)
    lines = F.filter(F.split(t, "\n"), lambda x: tx.strip(x) != "")
    code = code_like(t)
    legal = F.regexp_count(t, F.lit(fixed.LEGAL_CITE_PATTERN)) >= 3
    stops = tx.count_char(t, ".") + tx.count_char(t, "!") + tx.count_char(t, "?")
    reserved = (F.length(t) - F.length(F.replace(F.lower(t), F.lit("reserved"), F.lit("")))) / 8
    digits = F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))

    def by_lines(ls):
        n = F.size(ls)

        def share(test):
            return F.size(F.filter(ls, test)) / n

        return (
            ((n >= 6) & (share(lambda x: tx.count_char(x, "|") >= 2) > 0.6) & ~code)
            | ((n >= 6) & (share(lambda x: tx.count_char(x, "\t") >= 2) > 0.6))
            | ((n >= 8) & ~code & (share(lambda x: tx.word_count(x) <= 3) > 0.75) & (stops < 3))
        )

    return (
        F.when(tx.strip(t) == "", True)
        .when(reserved > 10, True)
        .when(tx.let(lines, by_lines), True)
        .when((F.length(t) > 300) & ~code & ~legal & (digits / F.length(t) > 0.55), True)
        .when((tx.word_count(t) > 200) & (stops == 0) & ~code & ~legal, True)
        .otherwise(False)
    )


def chunk_quality(c, title=None) -> Column:
    """Additive score of a chunk as a source of questions; 0 below 30 words."""
    t = _col(c)
    wc = tx.word_count(t)
    n_sent = F.size(F.filter(tx.sentences(t), lambda s: tx.word_count(s) >= 5))
    score = F.when((wc >= 50) & (wc <= 500), 2.5).when(wc < 50, 1.0).otherwise(1.5)
    score = score + F.when(n_sent >= 4, 2.0).when(n_sent >= 2, 1.0).otherwise(0.0)
    for phrases in fixed.QTYPE_TRIGGERS.values():
        score = score + F.least(tx.count_phrases(t, phrases) * 0.2, F.lit(1.0))
    score = score + F.when(t.rlike(r"\b\d[\d,\.]*\b"), 0.5).otherwise(0.0)
    score = score + F.when(F.contains(t, F.lit("$")) | F.contains(t, F.lit("%")), 0.5).otherwise(0.0)
    if title is not None:
        score = score + F.when(F.length(tx.strip(F.coalesce(_col(title), F.lit("")))) > 3, 0.5).otherwise(0.0)
    return F.when(wc < 30, F.lit(0.0)).otherwise(score)


def choose_qtype(c, coin1: Column, coin2: Column, coin3: Column) -> Column:
    """Question type: 15 % multi_hop, then 10 % comparison, else a weighted draw from the best two.

    Trigger counts are taken over the largest count. The three coins are numbers in
    [0, 1); pass hashes of the chunk id so reruns agree.
    """
    names = list(fixed.QTYPE_TRIGGERS)
    counts = F.array(*[tx.count_phrases(c, fixed.QTYPE_TRIGGERS[k]) for k in names])
    spare = F.get(F.array(F.lit("policy"), F.lit("factoid"), F.lit("eligibility")), F.floor(coin3 * 3).cast("int"))

    def ranked(n):
        top = F.greatest(F.array_max(n), F.lit(1))
        rows = F.array(*[
            F.struct((F.get(n, F.lit(i)) / top).alias("score"), F.lit(-i).alias("pos"), F.lit(k).alias("qtype"))
            for i, k in enumerate(names) if k not in ("multi_hop", "comparison")])
        return F.reverse(F.array_sort(F.filter(rows, lambda x: x["score"] > 0)))

    def draw(live):
        first, second = F.get(live, F.lit(0)), F.get(live, F.lit(1))
        w1, w2 = first["score"] + 0.1, second["score"] + 0.1
        return (
            F.when(F.size(live) == 0, spare).when(F.size(live) == 1, first["qtype"])
            .when(coin3 * (w1 + w2) < w1, first["qtype"]).otherwise(second["qtype"]))

    weighted = tx.let(counts, lambda n: tx.let(ranked(n), draw))
    return F.when(coin1 < 0.15, F.lit("multi_hop")).when(coin2 < 0.10, F.lit("comparison")).otherwise(weighted)


# ---- question/answer validation -------------------------------------------

def valid_pair(q, a) -> Column:
    q, a = _col(q), _col(a)
    return (
        (q != "") & (a != "") & (tx.word_count(a) >= 8) & (tx.word_count(q) >= 5)
        & ~((F.upper(a) == a) & (F.lower(a) != a)) & a.rlike("[a-zA-Z]")
        & ~q.rlike(fixed.CITATION_PATTERNS["any_bracket"]) & F.endswith(q, F.lit("?"))
    )


def grounded_18(a, chunk) -> Column:
    """At least 18 % of the answer's content tokens in the chunk, else 30 % of its bigrams."""
    def share(xs, ys):
        common = F.size(F.filter(xs, lambda x: F.array_contains(ys, x)))
        return F.coalesce(F.try_divide(common, F.size(xs)), F.lit(0.0))

    def test(at, ct):
        pairs = tx.let(tx.ngrams(at, 2), lambda ab: tx.let(
            tx.ngrams(F.filter(ct, lambda t: F.length(t) > 2), 2), lambda cb: share(ab, cb) >= 0.30))
        return F.when(F.size(at) == 0, False).when(share(at, ct) >= 0.18, True).otherwise(pairs)

    return tx.let(tx.content_tokens(a), lambda at: tx.let(tx.tokens_word(chunk), lambda ct: test(at, ct)))


def answer_depth(a) -> Column:
    return (
        tx.any_phrase(a, fixed.DEPTH_CONDITIONS)
        | _col(a).rlike(r"\b\d[\d,\.%]*\b")
        | tx.any_phrase(a, fixed.DEPTH_VALUES)
    )


def fluff(a) -> Column:
    return tx.any_phrase(a, fixed.FLUFF_PHRASES)


ARITHMETIC = r"\d+\s*[-+*/]\s*\d+"


def inferred_math(a, chunk) -> Column:
    return _col(a).rlike(ARITHMETIC) & ~_col(chunk).rlike(ARITHMETIC)


def clean_candidate_answer(a) -> Column:
    """Bracketed markers out, white space collapsed."""
    return F.regexp_replace(tx.strip_citations(a, "any_bracket"), r"\s+", " ")


def reject_reason(q, a, chunk) -> Column:
    """The first failing rule of a candidate, null when it passes."""
    return (
        F.when(~valid_pair(q, a), F.lit("invalid_pair"))
        .when(~grounded_18(a, chunk), F.lit("grounding"))
        .when(~answer_depth(a), F.lit("no_depth"))
        .when(fluff(a), F.lit("fluff"))
        .when(inferred_math(a, chunk), F.lit("inferred_math"))
    )


# ---- cleaning -------------------------------------------------------------

def bad_question(q) -> Column:
    return tx.any_phrase(q, fixed.BAD_QUESTION_PHRASES) | (tx.word_count(q) < 8) | F.startswith(F.lower(_col(q)), F.lit("why"))


def no_answer(a) -> Column:
    return tx.any_phrase(a, (fixed.NO_ANSWER_PHRASE,))


def corrupted(a) -> Column:
    a = _col(a)
    return (F.length(tx.strip(a)) < 8) | F.endswith(a, F.lit("...")) | tx.any_phrase(a, (fixed.CORRUPTED_PHRASE,))


def table_answer(a) -> Column:
    a = _col(a)
    return F.length(a) - F.length(F.regexp_replace(a, r"\d", "")) > 10


def strictly_grounded(a, chunk) -> Column:
    """Shared words reach max(6, half of the answer's words); an empty chunk passes."""
    aw = F.array_distinct(tx.tokens_word(a))
    shared = F.size(F.array_intersect(aw, tx.tokens_word(chunk)))
    return (F.coalesce(_col(chunk), F.lit("")) == "") | (shared >= F.greatest(F.lit(6), F.floor(0.5 * F.size(aw))))


def fake_reasoning(a) -> Column:
    return tx.any_phrase(a, fixed.FAKE_REASONING_PHRASES)


def complete(a) -> Column:
    return (tx.word_count(a) >= 12) & tx.any_phrase(a, fixed.COMPLETE_WORDS)


def complete_answer(q, a) -> Column:
    return (
        F.when(tx.word_count(a) < 12, False)
        .when(tx.any_phrase(q, fixed.CONDITION_QUESTION_WORDS), tx.any_phrase(a, fixed.COMPLETE_WORDS))
        .otherwise(True)
    )


def relevant(q, a) -> Column:
    return (
        F.when(tx.any_phrase(q, ("when",)), tx.any_phrase(a, ("if", "when", "must")))
        .when(tx.any_phrase(q, ("what",)), tx.word_count(a) > 10)
        .otherwise(True)
    )


def enrich_answer(a, chunk) -> Column:
    """A short answer becomes the first chunk sentence holding the answer's first 20 characters."""
    a, chunk = _col(a), F.coalesce(_col(chunk), F.lit(""))
    probe = F.lower(F.substring(a, 1, 20))
    hit = F.get(F.filter(F.split(chunk, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), probe)), F.lit(0))
    return F.when((tx.word_count(a) >= 15) | (chunk == ""), a).otherwise(F.coalesce(tx.strip(hit), a))


def diversify(q, coin: Column, pick: Column) -> Column:
    """Rewrite a known opening in half of the cases; ``coin`` and ``pick`` are numbers in [0, 1)."""
    q = _col(q)
    out = q
    for prefix, options in reversed(fixed.DIVERSIFY_PREFIXES):
        rest = F.substring(q, F.lit(len(prefix) + 1), F.length(q))
        new = F.get(F.array(*[F.lit(o) for o in options]), F.floor(pick * len(options)).cast("int"))
        out = F.when(F.startswith(q, F.lit(prefix)) & (coin < 0.5), F.concat(new, rest)).otherwise(out)
    return out


def fix_typos(q) -> Column:
    out = _col(q)
    for wrong, right in fixed.TYPO_FIXES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def rebalance_keep(qtype, coin: Column) -> Column:
    p = F.lit(1.0)
    for name, keep in fixed.REBALANCE_KEEP.items():
        p = F.when(_col(qtype) == name, F.lit(keep)).otherwise(p)
    return coin < p
