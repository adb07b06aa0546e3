import random

import pytest

pytest.importorskip("public_tokenizers")
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import bpe


@pytest.fixture(scope="module")
def enc():
    with open(bpe.default_path(), "rb") as f:
        return bpe.encoder(f.read())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PARTS = ["the", "ing", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "1234", "é", "한국", "Привет", "ÐŸÑ€", "🎬", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "--", "...", "﻿", "�", "a" * 70, "zq" * 40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_same_ids_as_library(enc, library, parts):
    s = "".join(parts)
    assert enc.ids(s) == library(s)


def test_long_and_random(enc, library):
    rng = random.Random(2)
    for s in ["a" * 20_000, " " * 5_000 + "x", "ab" * 9_999, "".join(rng.choices("etaoinshrdlu", k=30_000)), "".join(rng.choices("éüñß", k=5_000))]:
        assert enc.ids(s) == library(s)


def test_tables_start_anew(enc, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KEPT", 50)
    e = bpe.Encoder(enc.vocabulary)
    rng = random.Random(4)
    for _ in range(60):
        s = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20))
        assert e.ids(s) == library(s)
    assert len(e) <= 52


def test_lookahead_is_bounded(enc):
    t = bpe.Transducer(enc.vocabulary)
    s, emitted = 0, 0
    for byte in b"abcdefghijklmnopqrstuvwxyz" * 40:
        arc = t.arcs[s].get(byte) or t.step(s, byte)
        s, emitted = arc[0], emitted + len(arc[1])
        assert len(t.states[s][1]) <= 2 * enc.vocabulary.longest
    assert emitted > 100


def test_decoder_waits_for_whole_characters(enc):
    d = bpe.StreamDecoder(enc.vocabulary)
    out = [d.feed([i]) for i in enc.ids("한🎬é")]
    assert "".join(out) + d.end() == "한🎬é" and "�" not in "".join(out)
    d.feed(enc.ids("🎬")[:1])
    assert d.end() == "�"


def test_on_spark(spark, library):
    texts = [None, "", " ", "\n\n", "Hello, world! <|endoftext|>", "ÃÂ broken �", "x" * 1_000_000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text", rows=2).collect()}
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"], "text").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_fed_in_parts(enc, library):
    """Any cut of bytes or text gives the ids of the whole; the transducer's tables may start anew on the way."""
    rng = random.Random(6)
    for _ in range(200):
        s = "".join(rng.choices([*PARTS, "'", "'r", "e", "l", "don", "   "], k=rng.randint(0, 30)))
        e, out, i = bpe.StreamEncoder(enc), [], 0
        while i < len(s):
            n = rng.choice([1, 2, 5, 40])
            out += e.feed(s[i : i + n])
            i += n
        assert out + e.end() == library(s)
    t, word = bpe.Transducer(enc.vocabulary), "".join(rng.choices("etaoinshrdlu", k=4000))
    assert [x for k in range(0, 4000, 7) for x in t.feed(word[k : k + 7].encode())] + t.end() == library(word)


def test_transducer_starts_anew_while_fed(enc, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KEPT", 20)
    t, word = bpe.Transducer(enc.vocabulary), "".join(random.Random(8).choices("abcdefgh", k=2000))
    assert [x for k in range(0, 2000, 5) for x in t.feed(word[k : k + 5].encode())] + t.end() == library(word)
    assert len(t.states) < 60
