"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

The split pattern's matches are encoded one by one.  A match's neighbouring pairs are the
leaves of a segment tree: a leaf is the rank of the pair that starts at its byte, with the
byte's place in the low bits, so the root is the leftmost pair of the least rank.  A merge
joins that pair, drops the leaf of its second half, and updates the leaves of the merged
part and of its live left neighbour; each update climbs at most log2(n) nodes and stops
where a minimum stays as it was.  A match of n bytes takes O(n log n), also one that is as
long as a text.

Ranks travel by content with the task's function, and a worker keeps the ids of frequent
matches.  Texts are split in stretches of matches, so beside a text only one stretch's
matches and ids are in memory.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

#: Matches that a stretch has, that a worker keeps, and characters of the longest one it keeps.
STRETCH, STORE, STORED_LENGTH = 65_536, 1_000_000, 64
#: Longest match, in bytes, whose pairs are looked through one by one.
SHORT = 48
_NONE = 1 << 62


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(2)
def _ranks(content: bytes) -> dict[bytes, int]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must have every single byte")
    return ranks


@functools.lru_cache(4)
def _class(name: str) -> tuple[str, int]:
    """A property's characters by tiktoken's tables as a set for ``regex``, and the first code point where the two differ.

    Their Unicode versions may differ; what counts is how tiktoken splits.
    """
    single = tiktoken.Encoding("property", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    theirs = {ord(c) for c in single.decode_bytes(single.encode_ordinary(every)).decode()}
    ours = {ord(c) for c in regex.findall(name, every)}
    ranges: list[list[int]] = []
    for c in sorted(theirs):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]", min(theirs ^ ours, default=0x110000)


class Splitter:
    """The matches of a pattern as tiktoken finds them."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern, regex.V1)
        names = set(regex.findall(r"\\[pP]\{\^?\w+\}", pattern))
        exact, differ = pattern, 0x110000
        for name in names:
            own, first = _class(name)
            exact, differ = exact.replace(name, own), min(differ, first)
        # In UTF-8, code points at or above ``differ`` start with this byte or a larger one.
        self.lead = chr(differ).encode()[0] if differ < 0x110000 else 256
        self.exact = regex.compile(exact, regex.V1) if differ < 0x110000 else self.plain

    def matches(self, text: str, data: np.ndarray) -> Iterator[str]:
        """Matches of a text whose UTF-8 bytes are ``data``; both patterns find the same where no character is in doubt."""
        pattern = self.plain if not len(data) or data.max() < self.lead else self.exact
        return map(itemgetter(0), pattern.finditer(text))


_splitter = functools.lru_cache(2)(Splitter)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, by looking through all pairs for the least, which is quicker while they are few."""
    find, n = ranks.get, len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    pairs = [find(piece[i : i + 2], _NONE) for i in range(n - 1)]
    while pairs and (top := min(pairs)) != _NONE:
        i = pairs.index(top)
        del pairs[i]
        parts[i] = own = parts[i] + parts.pop(i + 1)
        if i < len(pairs):
            pairs[i] = find(own + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = find(parts[i - 1] + own, _NONE)
    return [ranks[part] for part in parts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    find = ranks.get
    whole = find(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    bits = n.bit_length()
    low, size = (1 << bits) - 1, 1 << (n - 2).bit_length()
    tree = [0] * size + [_NONE if (rank := find(piece[i : i + 2])) is None else rank << bits | i for i in range(n - 1)] + [_NONE] * (size - n + 1)
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))  # starts of the live neighbours
    ids = {}  # of merged parts, by their start
    while (top := tree[1]) != _NONE:
        here = top & low
        ids[here] = top >> bits
        gone = after[here]
        after[here] = end = after[gone]
        before[end] = here
        changed = [(size + here) >> 1]
        if end < n:  # else the gone part starts no pair
            rank = find(piece[here : after[end]])
            tree[size + here] = _NONE if rank is None else rank << bits | here
            tree[size + gone] = _NONE
            if (size + gone) >> 1 != changed[0]:
                changed.append((size + gone) >> 1)
        else:
            tree[size + here] = _NONE
        if here:
            left = before[here]
            rank = find(piece[left:end])
            tree[size + left] = _NONE if rank is None else rank << bits | left
            if (size + left) >> 1 != changed[0]:
                changed.append((size + left) >> 1)
        for node in changed:
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:
                    break
                tree[node] = a
                node >>= 1
    out, at = [], 0
    while at < n:
        out.append(ids[at] if at in ids else ranks[piece[at : at + 1]])
        at = after[at]
    return out


class Encoder:
    """Encodes texts in stretches; ``store`` holds the ids of frequent matches and is emptied when it is full."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks, self.splitter = _ranks(content), _splitter(pattern)
        self.store: dict[str, tuple[int, ...]] = {}
        top = max(self.ranks.values()) + 1
        self.bytes, self.decimal = [b""] * top, [str(i) for i in range(top)]
        for piece, i in self.ranks.items():
            self.bytes[i] = piece

    def stretches(self, text: str, data: np.ndarray) -> Iterator[list[int]]:
        """The ids of the text, a stretch of matches at a time."""
        found = self.splitter.matches(text, data)
        while own := list(islice(found, STRETCH)):
            if len(self.store) > STORE:
                self.store.clear()
            store, long = self.store, {}
            for word in set(own).difference(store):
                ids = tuple(merge(word.encode(), self.ranks))
                (store if len(word) <= STORED_LENGTH else long)[word] = ids
            if long:
                yield list(chain.from_iterable(store[w] if w in store else long[w] for w in own))
            else:
                yield list(chain.from_iterable(map(store.__getitem__, own)))

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(1)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(content, pattern)


def _encode(batches: Iterator[pa.RecordBatch], content: bytes, pattern: str, digest: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content, pattern)
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            parts, n = [], 0
            sums = hashlib.sha256(), hashlib.sha256()
            for ids in encoder.stretches(text.as_py(), data):
                if digest:
                    sums[0].update(((" " if n else "") + " ".join(map(encoder.decimal.__getitem__, ids))).encode())
                    sums[1].update(encoder.decoded(ids))
                else:
                    parts.append(np.array(ids, np.int32))
                n += len(ids)
            own = batch.column(0).slice(i, 1)
            if digest:
                last, names = [pa.array([s.hexdigest()]) for s in sums], ["ids_sha256", "decoded_sha256"]
            else:
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                last, names = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(flat))], ["ids"]
            yield pa.RecordBatch.from_arrays([own, pa.array([n], pa.int64()), *last], ["id", "n_tokens", *names])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """One row a document: id, n_tokens and ids; with ``digest`` ids_sha256 (of the decimal ids, joined by a space) and decoded_sha256 (of the bytes that the ids decode to) instead of ids.

    ``ranks`` is the path of a rank file, read by the driver, and ``pattern`` splits texts; the ids are
    those of the tiktoken library for both, without special tokens, whose strings are ordinary text.

    A null or empty text has no ids.  Null ids pass through, rows that repeat stay, other
    columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    content = Path(ranks or default_ranks()).read_bytes()
    schema = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return base.mapInArrow(functools.partial(_encode, content=content, pattern=pattern or default_pattern(), digest=digest), schema).withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], content: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content, pattern)
    for batch in batches:
        own = [None if ids is None else encoder.decoded(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], ["id", "text"])


def decode_tokens(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, text) of each row of ids; null ids give a null text, bytes that aren't UTF-8 a replacement character.  Unknown ids are an error."""
    bound_batches(rows.sparkSession)
    content = Path(ranks or default_ranks()).read_bytes()
    return rows.select(F.col(id_col).cast("long").alias("id"), ids_col).mapInArrow(functools.partial(_decode, content=content, pattern=pattern or default_pattern()), "id long, text string").withColumnRenamed("id", id_col)
