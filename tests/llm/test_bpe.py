from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ionweave.llm import bpe

from . import helpers as h


@pytest.fixture(scope="module")
def codec():
    return bpe.load_codec()


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    letters = " \t\n\r\x0b\x0c\x00\x1c\x85\u00a0\u3000abcXYZéß漢字'’123½²٣!?$🎉👩‍👩‍👧\u0301st'll<|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, "<|endoftext|>", "a" * 20000, " " * 5000, "ab" * 9000, "é" * 3000, h.prose(rng, 20000)]


def test_ids_equal_the_public_library(codec, encoding):
    texts = odd_texts()
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == encoding.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_long_texts_in_pieces(codec, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "_CHARS", 50)
    monkeypatch.setattr(bpe, "_PIECES", 7)
    texts = odd_texts()[:400]
    assert [i.tolist() for i in codec.encode(texts)] == [encoding.encode_ordinary(t or "") for t in texts]


def test_perfect_hash_is_minimal_and_total():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    table = bpe.PerfectHash(ranks)
    keys = list(ranks)
    assert sorted(table.rank.tolist()) == sorted(ranks.values())
    assert table.candidates(keys).tolist() == [ranks[k] for k in keys]
    small = bpe.PerfectHash({b"x": 3})
    assert small.candidates([b"x"]).tolist() == [3]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    own = bpe.load_codec()
    rng = random.Random(2)
    for _ in range(20):
        own.encode([h.prose(rng, 30)])
    assert len(own.memo) <= 50 + 70


def test_query_columns(spark, encoding):
    texts = ["Hello world", None, "", "Ünïcode", "Hello world"]
    docs = h.documents(spark, texts, extra=True)
    rows = bpe.round_trip(docs).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        ids = encoding.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(docs.limit(0)).collect() == []
    assert [len(r.ids) == r.n_tokens for r in bpe.tokenised(docs).collect()] == [True] * 5
