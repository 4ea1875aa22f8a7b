"""Pseudonyms against a plain Python version, validity, linkage and odd rows."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from askloom.llm import pii

KEY = "k"


def draw(tag, r, v):
    return int(hashlib.sha256(f"{KEY}|{tag}|{r}|{v}".encode()).hexdigest()[:15], 16)


def feistel(x, y, a, b, tag):
    for r in range(8):
        if r % 2 == 0:
            x = (x + draw(tag, r, y)) % a
        else:
            y = (y + draw(tag, r, x)) % b
    return x, y


def unfeistel(x, y, a, b, tag):
    for r in reversed(range(8)):
        if r % 2 == 0:
            x = (x - draw(tag, r, y)) % a
        else:
            y = (y - draw(tag, r, x)) % b
    return x, y


def luhn(s):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(s)))) % 10


def shown(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()]


def test_values(spark):
    texts = ["card 4111111111111111.", "card 4111-1111-1111-1111", "4111111111111112", "on 2024-02-29!", "2023-02-29", "29.02.2024", "12/31/1999", "1850-01-01",
             "at 10.0.0.255.", "300.1.1.1", "ssn 123-45-6789", "ssn 666-45-6789", "call +1 (743) 555-3824 now", "(743) 555-3824", "+49 30 1234567", "a.b@mail.com, x",
             'token = "11acdfb36bb72224148e6160f674b4be45601bff"', "v 2.0.1 and 1234", None, "", "é 10.0.0.255 é"]
    out = shown(spark, texts)
    n = len("411111111111111")
    x, y = feistel(4111111, 11111111, 10 ** 7, 10 ** 8, f"card{n}")
    body = f"{x:07d}{y:08d}"
    card = body + next(str(c) for c in range(10) if luhn(body + str(c)) == 0)
    assert out[0] == f"card {card}."
    assert out[1] == "card " + "-".join(card[i:i + 4] for i in range(0, 16, 4))
    assert [out[i] for i in (2, 4, 7, 9, 11, 17)] == [texts[i] for i in (2, 4, 7, 9, 11, 17)]
    day = (datetime.date(2024, 2, 29) - datetime.date(1901, 1, 1)).days
    x, y = feistel(day // 1461, day % 1461, 49, 1461, "date")
    fresh = datetime.date(1901, 1, 1) + datetime.timedelta(x * 1461 + y)
    assert out[3] == f"on {fresh.isoformat()}!" and out[5] == fresh.strftime("%d.%m.%Y")
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", out[6]) and out[6] != texts[6]
    x, y = feistel(10 * 256, 255, 65536, 65536, "ipv4")
    ip = f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    assert out[8] == f"at {ip}." and out[20] == f"é {ip} é"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", out[10]) and out[10] != texts[10]
    x, y = feistel(543, 3553824, 800, 8_000_000, "phone")
    assert out[12] == f"call +1 ({x + 200}) {str(y + 2_000_000)[:3]}-{str(y + 2_000_000)[3:]} now"
    assert out[13] == out[12][8:-4]
    assert re.fullmatch(r"\+49 \d\d \d{7}", out[14]) and out[14] != texts[14]
    assert re.fullmatch(r"user\.[0-9a-f]{16}@mail\.invalid, x", out[15])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[16]) and out[16] != texts[16]
    assert out[18] is None and out[19] == ""
    assert shown(spark, texts) == out


def test_permutation(spark):
    """Every value of a small format is hit once, and the key inverts it."""
    got = spark.range(1000).select("id", pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), KEY, "t").alias("p")).collect()
    assert len({r.p for r in got}) == 1000
    for r in got[::97]:
        x, y = unfeistel(int(r.p[:1]), int(r.p[1:]), 10, 100, "t3")
        assert x * 100 + y == r.id
    dates = [(datetime.date(1901, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(0, 71589, 7)]
    out = shown(spark, dates)
    assert len(set(out)) == len(dates) and all(datetime.date.fromisoformat(d).year in range(1901, 2097) for d in out)
    cards = [b + next(str(c) for c in range(10) if luhn(b + str(c)) == 0) for b in (f"4{i:014d}" for i in range(300))]
    out = shown(spark, cards)
    assert len(set(out)) == 300 and all(luhn(c) == 0 and len(c) == 16 for c in out)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "10.1.1.1", "x", "y"), (1, "10.1.1.1", "x", "y"), (None, None, None, None), (2, "word " * 200_000 + "10.1.1.1", "a", "b")],
                                 "doc_id long, text string, n_found string, _t string")
    out = pii.pseudonymise(rows, KEY)
    assert out.columns == ["doc_id", "text", "n_found", "_t", "n_changed"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    assert got[0] == got[1] and got[0].n_found == 1 and got[3].text is None
    assert got[2].text.startswith("word ") and not got[2].text.endswith("10.1.1.1")
    assert pii.pseudonymise(rows.limit(0), KEY).count() == 0
