"""Text as Column expressions: tokens, sentences, shingles, citation markers, prompts' pieces.

All of these stay inside the JVM. ``\\p{L}``/``\\p{N}`` classes are used instead of
``\\w`` because Java's ``\\w`` is ASCII only.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions import fixed

WORD_CHAR = r"[\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(values: Column, token=lambda x: x) -> Column:
    """Runs of equal tokens in a sorted array: array of struct(head, n); linear in its size."""
    def cut(u):
        fresh = lambda i: (i == 0) | (token(F.get(u, i)) != token(F.get(u, i - 1)))
        starts = F.when(F.size(u) > 0, F.filter(F.sequence(F.lit(0), F.size(u) - 1), fresh)).otherwise(F.array().cast("array<int>"))
        return let(starts, lambda at: F.transform(at, lambda p, i: F.struct(
            F.get(u, p).alias("head"), (F.coalesce(F.get(at, i + 1), F.size(u)) - p).alias("n"))))

    return let(values, cut)


def token_counts(tokens: Column) -> Column:
    """array of struct(head, n): each distinct token with its number, made within the row."""
    return runs(F.array_sort(tokens))


def strip(c) -> Column:
    """Remove white space at both ends, line breaks included."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def words(c) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(words(c))


def tokens_bm25(c) -> Column:
    """Lower-case, delete punctuation (not replaced by a space), split on white space."""
    return words(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_\s]", ""))


def tokens_alnum(c) -> Column:
    """``[a-z0-9]+`` runs of the lower-cased text; accents split words."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), 0)


def tokens_word(c) -> Column:
    """Unicode word-character runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_CHAR), 0)


def content_tokens(c, stopwords: Sequence[str] = fixed.CANONICAL_STOPWORDS) -> Column:
    """Word tokens longer than two characters that are not stopwords, repeats kept."""
    return F.filter(tokens_word(c), lambda x: (F.length(x) > 2) & ~x.isin(*stopwords))


def canonical_tokens(c) -> Column:
    return F.array_sort(F.array_distinct(content_tokens(c)))


def canonical_string(c) -> Column:
    return F.array_join(canonical_tokens(c), " ")


def sentences(c) -> Column:
    """Split after ``.``, ``!`` or ``?``; empty pieces dropped."""
    return F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: strip(s) != "")


def long_sentences(c, min_words: int = 5) -> Column:
    """Sentences of the text with line breaks as spaces, at least ``min_words`` words."""
    parts = F.split(F.replace(_col(c), F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: word_count(s) >= min_words)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of ``n`` tokens; none when there are fewer."""
    return let(tokens, lambda t: F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")),
    ).otherwise(F.array().cast("array<string>")))


def word_shingles(c, n: int = fixed.SHINGLE_WORDS) -> Column:
    """Lower-cased word n-grams; a shorter text is one shingle, an empty one none."""
    return let(words(F.lower(_col(c))), lambda w: (
        F.when(F.size(w) >= n, ngrams(w, n))
        .when(F.size(w) > 0, F.array(F.array_join(w, " ")))
        .otherwise(F.array().cast("array<string>"))
    ))


def strip_citations(c, kind: str = "any_id") -> Column:
    return strip(F.regexp_replace(_col(c), fixed.CITATION_PATTERNS[kind], ""))


def citation_markers(c, kind: str = "any_id") -> Column:
    """Array of (doc_id, span_start, span_end) in order of appearance."""
    rx = F.lit(fixed.CITATION_PATTERNS[kind])
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(_col(c), rx, 1).alias("d"),
            F.regexp_extract_all(_col(c), rx, 2).alias("s"),
            F.regexp_extract_all(_col(c), rx, 3).alias("e"),
        ),
        lambda m: F.struct(
            m["d"].alias("doc_id"), m["s"].cast("int").alias("span_start"), m["e"].cast("int").alias("span_end")
        ),
    )


def capped(c, limit: int = fixed.CITE_TEXT_MAX) -> Column:
    """Longer texts become their first ``limit - 3`` characters and ``...``."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def any_phrase(c, phrases: Iterable[str]) -> Column:
    """True when the lower-cased text contains one of the phrases."""
    return let(F.lower(_col(c)), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in phrases)))


def count_phrases(c, phrases: Iterable[str]) -> Column:
    """How many of the phrases the lower-cased text contains."""
    return let(F.lower(_col(c)), lambda low: reduce(add, (F.contains(low, F.lit(p)).cast("int") for p in phrases)))


def count_char(c, ch: str) -> Column:
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def truncate_at_stop(c, stops: Sequence[str] = fixed.STOP_STRINGS) -> Column:
    """Cut a text at the earliest of the stop strings."""
    alternatives = "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s) for s in stops)
    return strip(F.regexp_replace(_col(c), f"(?s)({alternatives}).*$", ""))


def attach_marker(answer, marker) -> Column:
    """Put ``marker`` before the final punctuation of the last sentence."""
    joined = F.array_join(F.split(strip(answer), r"(?<=[.!?])\s+"), " ")
    last = F.right(joined, F.lit(1))
    return F.when(
        last.isin(".", "!", "?"),
        F.concat(F.left(joined, F.length(joined) - 1), _col(marker), last),
    ).otherwise(F.concat(joined, _col(marker)))


def small_talk_class(c) -> Column:
    """greeting, thanks, farewell or affirmation; null for anything with a real question in it."""
    t = strip(c)
    out = F.when(t == "", None).when(t.rlike("(?i)" + fixed.REAL_QUESTION), None)
    for name, rx in fixed.SMALL_TALK.items():
        out = out.when(t.rlike(r"(?i)^\s*" + rx + r"[\s!?.]*$"), F.lit(name))
    return out.otherwise(None)


def refine_query(query, topics, iteration) -> Column:
    """Append the hint of the iteration and up to five visited topics to leave out."""
    hints = F.array(*[F.lit(h) for h in fixed.REFINE_HINTS])
    hint = F.get(hints, F.least(_col(iteration), F.lit(len(fixed.REFINE_HINTS) - 1)))
    kept = F.slice(F.array_sort(F.array_distinct(F.filter(_col(topics), lambda x: x.isNotNull() & (x != "")))), 1, 5)
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("Exclude: "), F.array_join(kept, "; ")))
    return F.concat_ws("\n", _col(query), hint, tail)


SEPARATORS = "(?i)" + "|".join(fixed.SPLIT_SEPARATORS)


def multi_part_by_split(c) -> Column:
    """More than one question mark, or more than one piece between separators."""
    q = strip(c)
    pieces = F.filter(F.split(q, SEPARATORS), lambda p: strip(p) != "")
    return F.when(q == "", False).otherwise((count_char(q, "?") > 1) | (F.size(pieces) > 1))


def multi_part_by_word(c) -> Column:
    """At least two question marks, or a conjunction word."""
    return (count_char(c, "?") >= 2) | _col(c).rlike("(?i)" + fixed.CONJUNCTION)


def split_sub_queries(c, limit: int = fixed.MAX_SUB_QUERIES) -> Column:
    """Pieces between separators, question marks restored, case-insensitively distinct, at most ``limit``."""
    pieces = F.filter(F.transform(F.split(_col(c), SEPARATORS), strip), lambda p: p != "")
    repaired = let(pieces, lambda ps: F.transform(
        ps,
        lambda p, i: F.when((i < F.size(ps) - 1) & ~F.endswith(p, F.lit("?")), F.concat(F.regexp_replace(p, r"\.+$", ""), F.lit("?"))).otherwise(p),
    ))
    bare = F.filter(F.transform(repaired, lambda p: strip(F.regexp_replace(p, r"^[-*]+|[-*]+$", ""))), lambda p: p != "")
    return let(bare, lambda b: let(F.transform(b, lambda p: F.lower(p)), lambda low: let(
        F.filter(b, lambda p, i: F.array_position(low, F.lower(p)) == i + 1),
        lambda d: F.when(F.size(d) == 0, F.array(strip(c))).otherwise(F.slice(d, 1, limit)))))


def split_labelled(c) -> Column:
    """The label maker's split: after question marks, else at conjunction words; pieces over 3 characters."""
    c = _col(c)
    parts = F.when(F.contains(c, F.lit("?")), F.split(c, r"(?<=\?)\s+")).otherwise(F.split(c, "(?i)" + fixed.CONJUNCTION))
    kept = F.filter(F.transform(parts, strip), lambda p: F.length(p) > 3)
    return F.when(F.size(kept) < 2, F.array(c)).otherwise(kept)


def flatten_cells(c) -> Column:
    """A matrix of cells as tab- and line-separated text under a ``[TABLE]`` line."""
    rows = F.transform(_col(c), lambda r: F.array_join(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), "\t"))
    return F.concat(F.lit("[TABLE]\n"), strip(F.array_join(rows, "\n")))


def context_line(doc_id, start, end, text, sep: str = " ") -> Column:
    """``[id:start-end] text`` with the id cut to 16 characters."""
    return F.concat(
        F.lit("["), F.substring(_col(doc_id), 1, 16), F.lit(":"), _col(start).cast("string"), F.lit("-"),
        _col(end).cast("string"), F.lit("]" + sep), _col(text),
    )
