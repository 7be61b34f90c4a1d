"""Byte pairs against the tiktoken library, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from quire.llm import byte_pairs
from quire.llm.byte_pairs import Encoder, decode_tokens, default_pattern, default_ranks, encode_texts, merge

SCHEMA = "doc_id long, text string, id string, n_tokens int, ids string"


@pytest.fixture(scope="module")
def content():
    with open(default_ranks(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(content):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(content, library):
    encoder, rng = Encoder(content, default_pattern()), random.Random(2)
    letters = "aeé ñ\n\t  's'll THEthe1२٣ßŁжж日本語😀՘꟎\U0003fc3c\x1c\x85 <|endoftext|>"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(1500)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(every[a : a + 9000]) for a in range(0, len(every), 90_000)]
    for text in texts:
        ids = [i for s in encoder.stretches(text, np.frombuffer(text.encode(), np.uint8)) for i in s]
        assert ids == library.encode_ordinary(text), text
        assert encoder.decoded(ids).decode() == text


def test_merge_is_leftmost_least_rank_at_any_length(content, library):
    encoder, rng = Encoder(content, default_pattern()), random.Random(4)

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(encoder.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            least = min((r for r in ranked if r[0] is not None), default=None)
            if least is None:
                break
            i = least[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [encoder.ranks[p] for p in parts]

    for n in (*range(1, 40), 63, 64, 65, 200):
        for letters in (b"ab", b"etaoin", bytes(range(256))):
            piece = bytes(rng.choices(letters, k=n))
            assert merge(piece, encoder.ranks) == ([encoder.ranks[piece]] if piece in encoder.ranks else slow(piece))
    long = "".join(rng.choices("abcde", k=60_000))
    assert merge(long.encode(), encoder.ranks) == library.encode_ordinary(long)


def test_other_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"ab": 301, b"abc": 302, b"aa": 256}
    assert merge(b"abc", ranks) == [302]
    assert merge(b"xabcd", ranks) == [120, 302, 100] and merge(b"xabc", {k: v for k, v in ranks.items() if v != 302}) == [120, 97, 300]
    assert merge(b"aaaaa", ranks) == [256, 256, 97]


def test_frames(spark, library):
    rows = [(1, "Hello  world's\n\n end <|endoftext|>"), (2, None), (3, ""), (None, "null id"), (1, "Hello  world's\n\n end <|endoftext|>"), (4, "a" * 70_000 + " " * 70_000), (5, "word " * 90_000), (6, "퟿ ünï"), (7, " ")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    plain = lambda t: library.encode_ordinary(t or "")
    key = lambda r: (r[0] is None, r[0] or 0)
    found = encode_texts(docs)
    assert sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in found.collect()), key=key) == sorted(((i, len(plain(t)), plain(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.text) for r in decode_tokens(found).collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = [(i, len(plain(t)), sha(" ".join(map(str, plain(t)))), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, encode_texts(docs, digest=True).collect()), key=key) == sorted(digests, key=key)
    assert encode_texts(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [255])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_tokens(odd).collect()} == {1: None, 2: "", 3: library.decode([255])}


def test_short_matches_merge_as_long_ones(monkeypatch, content):
    """Both ways to find the least pair give the same ids, also where equal pairs overlap."""
    rng, ranks = random.Random(12), byte_pairs._ranks(content)
    pieces = [bytes(rng.choice(b"aab e\xc3\xa9") for _ in range(n)) for n in range(2, 90) for _ in range(4)] + [b"a" * n for n in range(2, 90)]
    short = [byte_pairs._merge_short(p, ranks) if p not in ranks else [ranks[p]] for p in pieces]
    monkeypatch.setattr(byte_pairs, "SHORT", 0)
    assert short == [byte_pairs.merge(p, ranks) for p in pieces]
