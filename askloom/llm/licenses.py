"""License notices in whole texts: exact phrases, and short notices with a few edits.

A notice of m characters that may differ by k edits is cut into k + 1 parts. By the
pigeonhole principle one part occurs unchanged, so an automaton over all parts finds every
candidate place; the ``regex`` library then matches the whole notice with a bound on the
edits around that place and gives the span. Every candidate place has a window of its own; of
overlapping finds the one of fewest edits stays (ties: the leftmost), and what it leaves free of
the others' windows is searched again. Texts are compared as lower-cased words with
single blanks between them, so line breaks and punctuation cost no edits.

Defined results: a null or empty text has no words, no places and score 0; equal rows give
equal results; only the key and the text are read, so no other column can clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from askloom.llm import spans

# Phrases that are counted exactly, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices that are searched with edits, with their labels; a parameter of ``scan``.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "under the terms of the gnu general public license": "gpl",
    "this program is free software you can redistribute it": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "creative commons attribution": "cc",
    "this work is dedicated to the public domain": "public-domain",
}

_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = True
_WORD[ord("a"):ord("z") + 1] = True
_WORD[0x80:] = True


def edits(notice: str) -> int:
    """Edits allowed for a notice: one for each twelve characters."""
    return max(1, len(notice) // 12)


def parts(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice in k + 1 parts of nearly equal length, with their offsets."""
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


@lru_cache(4)
def _machine(notices: tuple[str, ...]) -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    places: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for at, part in parts(notice, edits(notice)):
            places.setdefault(part, []).append((i, at))
    machine = ahocorasick.Automaton()
    for part, where in places.items():
        machine.add_word(part, (len(part), where))
    machine.make_automaton()
    return machine, [regex.compile(f"(?be)(?:{regex.escape(n)}){{e<={edits(n)}}}") for n in notices]


def notice_spans(text: str, notices: tuple[str, ...]) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, edits) of the notices in one line of words, sorted.

    ``text`` holds words separated by single blanks, texts separated by line feeds. Places
    of one notice do not overlap.
    """
    machine, patterns = _machine(notices)
    windows: dict[int, dict[tuple[int, int], None]] = {}
    for end, (size, where) in machine.iter(text):
        for i, at in where:
            k = edits(notices[i])
            first = end + 1 - size - at
            lo, hi = max(first - k, 0), min(first + len(notices[i]) + k, len(text))
            lo = max(lo, text.rfind("\n", lo, end + 1 - size) + 1)
            feed = text.find("\n", end + 1, hi)
            windows.setdefault(i, {})[lo, hi if feed < 0 else feed] = None
    return sorted((a, z, i, e) for i, mine in windows.items() for a, z, e in _apart(text, patterns[i], len(notices[i]) - edits(notices[i]), mine))


def _apart(text: str, pattern: regex.Pattern, least: int, windows: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of places that do not overlap, found in the windows; none is shorter than ``least``."""
    waiting: list[tuple[int, int, int, int, int]] = []
    taken: list[tuple[int, int, int]] = []

    def search(lo: int, hi: int) -> None:
        m = pattern.search(text, lo, hi) if hi - lo >= least else None
        if m:
            heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

    for lo, hi in windows:
        search(lo, hi)
    while waiting:
        e, a, z, lo, hi = heappop(waiting)
        at = bisect_left(taken, (a,))
        before, after = taken[at - 1] if at else None, taken[at] if at < len(taken) else None
        if (before and before[1] > a) or (after and after[0] < z):
            # the free parts of the window: places in it begin and end between taken ones
            for t in taken[max(at - 1, 0):bisect_left(taken, (hi,))]:
                if t[1] > lo:
                    search(lo, t[0])
                    lo = max(lo, t[1])
            search(lo, hi)
        else:
            insort(taken, (a, z, e))
    return taken


def _normal(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Words with one blank after each, texts ended by line feeds; characters at which words and texts start."""
    size = ends - starts
    n_texts = len(offsets) - 1
    slot = np.arange(len(starts)) + np.repeat(np.arange(n_texts), np.diff(offsets))  # a line feed per text before
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    to = begin[:-1] + slot
    out = np.full(int(begin[-1]) + len(starts) + n_texts, 0x20, np.uint8)
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    out[np.repeat(to, size) + inner] = raw[np.repeat(starts, size) + inner]
    text_end = begin[offsets[1:]] + offsets[1:] + np.arange(n_texts)
    out[text_end] = 0x0A
    chars = np.cumsum((out & 0xC0) != 0x80) - 1
    text_start = np.concatenate([[0], text_end[:-1] + 1]) if n_texts else text_end
    return out.tobytes().decode(), chars[to], chars[text_start]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: places of phrases, labels, spans of notices, and a score.

    Columns: key, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    spans: array of (label, first_word, last_word, edits). The score is 1 with an exact
    phrase, else the best notice's share of unedited characters, else 0.
    """
    phrases, notices = phrases or PHRASES, notices or NOTICES
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])

    def run(batches):
        names = tuple(notices)
        wanted = [(_hashed(p), label) for p, label in phrases.items()]
        for b in batches:
            for lo, hi, raw, at in spans.pieces(b.column(1)):
                raw = spans.LOWER[raw]
                starts, ends, offsets = spans.runs(_WORD[raw], at)
                key_of = spans.hashes(raw, starts, ends)
                n = len(at) - 1
                n_base = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for words, label in wanted:
                    fits = spans.whole_grams(offsets, len(words))
                    for j, w in enumerate(words):
                        fits &= key_of[j:j + len(fits)] == w
                    place = np.flatnonzero(fits)
                    row = np.searchsorted(offsets, place, side="right") - 1
                    np.add.at(n_base, row, 1)
                    np.minimum.at(first, row, place - offsets[row])
                    np.maximum.at(last, row, place - offsets[row])
                    for r in np.unique(row):
                        labels[r].add(label)
                more = [set(x) for x in labels]
                found: list[list[tuple]] = [[] for _ in range(n)]
                score = (n_base > 0).astype(float)
                line, word_at, text_at = _normal(raw, starts, ends, offsets)
                for a, z, i, e in notice_spans(line, names):
                    r = int(np.searchsorted(text_at, a, side="right")) - 1
                    w0 = max(int(np.searchsorted(word_at, a, side="right")) - 1, int(offsets[r]))
                    w1 = int(np.searchsorted(word_at, z - 1, side="right")) - 1
                    found[r].append((notices[names[i]], w0 - int(offsets[r]), w1 - int(offsets[r]), e))
                    more[r].add(notices[names[i]])
                    score[r] = max(score[r], 1 - e / len(names[i]))
                empty = n_base == 0
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()), pa.array(n_base),
                    pa.array(first, pa.int64(), mask=empty), pa.array(last, pa.int64(), mask=empty),
                    pa.array([",".join(sorted(x)) for x in labels]), pa.array([",".join(sorted(x)) for x in more]), pa.array(score),
                    pa.array([[dict(zip(span.names, x)) for x in f] for f in found], pa.list_(span))],
                    ["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = (f"k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "spans array<struct<label:string,first_word:long,last_word:long,edits:long>>")
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def _hashed(phrase: str) -> np.ndarray:
    raw = np.frombuffer(phrase.encode(), np.uint8)
    starts, ends, _ = spans.runs(_WORD[raw], np.array([0, len(raw)]))
    return spans.hashes(raw, starts, ends)
