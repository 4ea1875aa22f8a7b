"""Phrase places against plain Python; notices with edits, their spans, and what is too far off."""

import random
import re

from askloom.llm import licenses


def brute(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base(spark):
    r = random.Random(4)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "é", "x1", "\n", "gnu-", "licenses", "mit license"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 30))), 1) for i in range(400)]
    rows += [(900, None, 1), (901, "", 1), (902, "MIT\x00LICENSE", 1), (903, "mitlicense", 1), (904, "mit éLicense", 1), (None, "Apache_License", 1), (900, None, 1), (905, "w " * 50_000 + "mit license", 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == sorted([(k, *brute(t)) for k, t, _ in rows], key=str)
    assert all(0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1) for r in got)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_notices(spark):
    """A notice with as many edits as allowed is found wherever it stands, with its words; one with more is not."""
    r = random.Random(5)
    rows, want = [], {}
    for i, (notice, label) in enumerate(licenses.NOTICES.items()):
        for extra in (0, 2):
            text = list(notice)
            k = licenses.edits(notice)
            places = sorted(r.sample([j for j, c in enumerate(text) if c != " " and 0 < j < len(text) - 1], k if not extra else min(3 * k + 3, len(text) // 2)))
            for j in places:
                text[j] = "q"
            before = r.randint(0, 5)
            key = i * 10 + extra
            rows.append((key, "zz " * before + "".join(text).replace(" ", r.choice([" ", "\n", ", "])) + "! zz"))
            want[key] = (label, before, before + notice.count(" "), k) if not extra else None
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, w in want.items():
        mine = [tuple(s) for s in got[key].spans]
        if w:
            assert any(s[:3] == w[:3] and s[3] <= w[3] for s in mine), (key, mine, w)
            assert w[0] in got[key].labels.split(",") and got[key].score > 0.9
        else:
            assert not [s for s in mine if s[0] == licenses.NOTICES[list(licenses.NOTICES)[key // 10]]], (key, mine)


def test_places_do_not_cross_texts():
    line = "released under the mit\nlicense\n"
    assert not [s for s in licenses.notice_spans(line, tuple(licenses.NOTICES)) if s[3] == 0]


def test_notices_that_stand_close_together():
    """A place with edits is not lost to a better one beside it, on either side; an overlapping one of more edits is."""
    names = ("licensed under the bsd license",)
    exact, edited = names[0], "licensed under the bsd licemse"
    for line in ([edited, exact], [exact, edited], [edited, edited, exact, edited], [exact] * 3, [edited] * 40):
        text, want, at = " ".join(line), [], 0
        for part in line:
            want.append((at, at + len(part), 0, int(part == edited)))
            at += len(part) + 1
        assert licenses.notice_spans(text + " \n", names) == want
    r = random.Random(8)
    for _ in range(60):
        names = tuple(licenses.NOTICES)
        line = []
        for _ in range(r.randint(1, 6)):
            i = r.randrange(len(names))
            text = list(names[i])
            if r.random() < 0.7:
                text[r.randrange(1, len(text) - 1)] = "q"
            line += ["zz"] * r.randint(0, 1) + ["".join(text)]
        text = " ".join(line)
        found = licenses.notice_spans(text + " \n", names)
        at = 0
        for part in line:
            if part != "zz":
                assert any(a < at + len(part) and z > at and e <= 1 for a, z, _, e in found), (text, part, found)
            at += len(part) + 1
        by = {}
        for a, z, i, e in found:
            assert z - a >= len(names[i]) - licenses.edits(names[i]) and e <= licenses.edits(names[i])
            assert a >= by.get(i, 0)
            by[i] = z
