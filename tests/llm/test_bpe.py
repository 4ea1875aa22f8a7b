"""Ids, digests and round trips against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from askloom.llm import bpe, spans
from askloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(1)
    odd = ["", None, "it's we'll they've I'm  'd 'll's 'S ' s \n\n x\t\ty  ", "a" * 1000 + "b" * 301, "ab" * 900, "<|endoftext|>x<|endoftext|> <|endo", "é" * 300 + " 漢字 ½ ²x    y \U0001f600\U0001f600 \u0085 \x1c\x1d a",
           "  lead", "trail  ", "x'sabc !'s 's's 're've", "   \n  a", "   \n", "a\r\n\r\n b", "'", "'s", "''s", "1'st", "　'll", " 'll", "日本語テキスト'sです", "a<|endoftext|>", "<|endoftext|>"]
    alphabet = " '\n\tstrevmlld1é!.   漢"
    odd += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    odd += ["".join(chr(r.choice([r.randint(1, 0x2ff), r.randint(0x300, 0xd7ff), r.randint(0xe000, 0x2ffff)])) for _ in range(30)) for _ in range(1000)]
    odd += ["".join(r.choice("abcdefgh") for _ in range(3000))]
    return odd


@pytest.mark.parametrize("size", [1 << 22, 500])
def test_ids(library, monkeypatch, size):
    monkeypatch.setattr(spans, "PIECE_BYTES", size)
    rows, content = texts(), bpe.read_vocabulary(vocabulary())
    got = []
    for _, _, e in bpe.encode_pieces(content, pa.array(rows)):
        ids, at = e.text_ids()
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    want = [e.ids for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert got == want


def test_long_words_merge_alike():
    v = bpe.Vocabulary(bpe.read_vocabulary(vocabulary()))
    r = random.Random(2)
    words = ["".join(r.choice("thean ing") for _ in range(r.randint(1, 250))).encode() for _ in range(300)] + [b"a" * 256, b"ab" * 128]
    raw = np.frombuffer(b"".join(words), np.uint8)
    offsets = np.cumsum([0, *map(len, words)])
    ids, cut = bpe.merge_words(v, raw, offsets)
    for i, w in enumerate(words):
        assert ids[cut[i]:cut[i + 1]].tolist() == bpe._merge_long(v, v.byte_ids[np.frombuffer(w, np.uint8)].tolist())


def test_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:300])] + [(None, "z", None), (3, "again", "k"), (3, "again", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = sorted(map(tuple, bpe.round_trip(df, vocabulary()).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()}
    assert back == {(k, t or "") for k, t, _ in rows}
    assert bpe.round_trip(df.limit(0), vocabulary()).count() == 0
