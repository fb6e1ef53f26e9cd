"""The encoder against two public libraries, whole and in parts."""

import base64
import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skein.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "'r", "1", "²", "½", "é", "ſ", "\x1c", "\x85", "\xa0", "​", "漢", "👩", "Ⅳ", "_", "-", "\t", "\r\n", "th", "ing", "<|endoftext|>", "　", "﻿", "İ", "́", "٣"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def streamed(text, rng, widest):
    stream, ids, at = bpe.StreamEncoder(bpe.vocabulary()), [], 0
    while at < len(text):
        n = rng.randint(1, widest)
        ids += stream.feed(text[at : at + n])
        at += n
    return ids + stream.finish()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=30).map("".join), st.integers(0, 99))
def test_short_texts(reference, text, seed):
    ids = bpe._encoder(bpe.VOCABULARY).encode(text)
    assert ids == reference.encode_ordinary(text) == streamed(text, random.Random(seed), 4)
    state = bpe.StreamDecoder(bpe.vocabulary())
    assert "".join(state.feed([i]) for i in ids) + state.finish() == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_characters(reference, text):
    ids = bpe._encoder(bpe.VOCABULARY).encode(text)
    state = bpe.StreamDecoder(bpe.vocabulary())
    assert state.feed(ids) + state.finish() == text
    assert streamed(text, random.Random(0), 3) == ids


def test_same_as_the_library_with_special_tokens_off(reference):
    from tokenizers import Tokenizer

    path = bpe.VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no file")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 30)))
        assert bpe._encoder(bpe.VOCABULARY).encode(text) == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", range(6))
def test_long_pieces_stay_stable(reference, monkeypatch, kind):
    monkeypatch.setattr(bpe, "LONG_PIECE", 16)
    rng = random.Random(kind)
    makers = [
        lambda: "".join(rng.choice("ab") for _ in range(5000)), lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)),
        lambda: " " * 3000 + rng.choice(["", "x", " x"]) + "\n" * 300, lambda: rng.choice("ae") * 4000 + " " + rng.choice("-=_") * 3000,
        lambda: "".join(rng.choice(["the", "ing", "er", "un", "in", "st", "re", "on"]) for _ in range(2500)), lambda: "  " + "1" * 3000 + "é" * 2000 + "\t" * 50 + "Z",
    ]
    for _ in range(8):
        text = makers[kind]()
        assert streamed(text, rng, 400) == reference.encode_ordinary(text)


def test_memory_of_the_stream_is_bounded():
    vocab = bpe.vocabulary()
    stream, most = bpe.StreamEncoder(vocab), 0
    for _ in range(300):
        stream.feed("abcdefghij" * 100)
        most = max(most, len(stream.text) + len(stream.stream.data if stream.stream else b""))
    assert 0 < vocab.lookahead < 5000 and most < 2 * vocab.lookahead + 3 * bpe.LONG_PIECE


def test_long_text_is_encoded_in_parts(reference):
    text = "The quick brown fox's 12 hens, " * 9000 + "x" * 90_000
    assert len(text) > bpe.LONG_TEXT
    assert bpe._encoder(bpe.VOCABULARY).encode(text) == reference.encode_ordinary(text)
    assert bpe._encoder(bpe.VOCABULARY).count(text) == len(reference.encode_ordinary(text))


def test_documents(spark):
    rows = [(1, "a b"), (2, ""), (3, None), (None, "x"), (1, "a b"), (4, " \n "), (5, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = bpe.encode_documents(docs)
    assert sorted(((r.doc_id or 0, list(r.ids)) for r in got.collect()), key=str)[:3] == [(0, [87]), (1, [64, 275]), (1, [64, 275])]
    ids = {r.doc_id: list(r.ids) for r in got.collect()}
    assert ids[2] == ids[3] == [] and 50256 not in ids[5] and len(ids[5]) > 1
    texts = {r.doc_id: r.text for r in bpe.decode_documents(got).collect()}
    assert texts == {1: "a b", 2: "", 3: "", None: "x", 4: " \n ", 5: "<|endoftext|>"}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, ("doc_id",)).collect()}
    assert counts == {k: len(v) for k, v in ids.items()}
    assert bpe.encode_documents(docs.where("false")).count() == 0


def test_broken_bytes_become_replacement_characters():
    vocab = bpe.vocabulary()
    state = bpe.StreamDecoder(vocab)
    lead = vocab.ranks[b"\xc3"]
    assert state.feed([lead]) == "" and state.feed([vocab.ranks[b"a"]]) == "�a" and state.feed([lead]) + state.finish() == "�"


def test_every_text_passes_through_the_stream(monkeypatch):
    fed, feed = [], bpe.StreamEncoder.feed
    monkeypatch.setattr(bpe.StreamEncoder, "feed", lambda self, text: (fed.append(text), feed(self, text))[1])
    encoder = bpe.Encoder(bpe.vocabulary())
    for text in ("a", "Die Zeitung, 1899.\n", " word" * 900 + "  "):
        fed.clear()
        ids = encoder.encode(text)
        assert "".join(fed) == text and max(map(len, fed)) <= bpe.LONG_TEXT
        state = bpe.StreamDecoder(encoder.vocab)
        assert state.feed(ids) + state.finish() == text and encoder.count(text) == len(ids)
        assert ids == [i for piece in bpe._automata()[0].findall(text) for i in encoder.vocab.encode_piece(piece.encode())]
