"""Encoding in bounded memory: many different words, long words a few steps at a time, long texts bit by bit."""

import random

import tiktoken

from intakeloom.llm import bpe
from intakeloom.llm.queries import vocabulary


def test_bounded_queries(monkeypatch):
    path, pattern = vocabulary()
    ranks = bpe.read_ranks(path)
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(2)

    def letters(n):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))

    texts = [letters(700), "ab" * 300 + " " + letters(90), " ".join(letters(30) for _ in range(300)), "", None, "=" * 2000]
    wanted = [public.encode_ordinary(text or "") for text in texts]
    assert bpe.Encoder(ranks, pattern).encode(texts).to_pylist() == wanted
    monkeypatch.setattr(bpe, "HELD", 3000)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "PART", 7)
    encoder = bpe.Encoder(ranks, pattern)
    assert encoder.encode(texts).to_pylist() == wanted
    assert [encoder.encode([text]).to_pylist()[0] for text in texts] == wanted
    encoder.store.close()


def test_many_different_words():
    """60,000 different words of 40 letters, which one query could not hold."""
    path, pattern = vocabulary()
    ranks = bpe.read_ranks(path)
    draw = random.Random(1)
    text = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(60_000))
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, pattern)
    assert encoder.encode([text]).to_pylist()[0] == public.encode_ordinary(text)
    encoder.store.close()
