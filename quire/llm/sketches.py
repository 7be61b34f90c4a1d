"""Word-shingle sets and one-permutation MinHash sketches of whole texts (numpy, per slice)."""

from __future__ import annotations

import numpy as np

from .rolling import BYTE_CODE, LOWER, U, mix, prefix_sums, span_hash, word_spans

_SALT = U(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and the index of each text's first.

    A-Z is lower-cased.  A text of fewer than ``size`` words has its whole sequence as
    its one shingle; a text without words has none.
    """
    starts, ends, first = word_spans(data, offsets)
    sums = prefix_sums(span_hash(prefix_sums(BYTE_CODE[LOWER[data]]), starts, ends))
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count)
    hashes = span_hash(sums, begin, np.minimum(begin + size, np.repeat(first[1:], count)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][count > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def set_digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each set; equal sets have equal sums, in whatever order."""
    out = []
    for salt in (_SALT, _SALT << U(1)):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ salt), dtype=U)])
        out.append(sums[at[1:]] - sums[at[:-1]])
    return out[0], out[1]


def one_permutation(hashes: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification: a row of ``bins`` values a set.

    The high bits of a hash choose its bin and the least hash of a bin is its value.  An
    empty bin copies the bin that a hash of (its number, attempt) names, the attempts
    going on until a filled one is hit.  Sets must not be empty.
    """
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    place = ((hashes >> U(32)) * U(bins) >> U(32)).astype(np.int64) + row * bins
    lead = np.ones(len(place), bool)
    lead[1:] = place[1:] != place[:-1]
    values, filled = np.zeros(n * bins, U), np.zeros(n * bins, bool)
    values[place[lead]], filled[place[lead]] = hashes[lead], True
    empty, attempt = np.flatnonzero(~filled), 1
    while len(empty):
        own = empty % bins
        source = empty - own + (mix(own.astype(U) * _SALT + U(attempt)) % U(bins)).astype(np.int64)
        hit = filled[source]
        values[empty[hit]] = values[source[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return values.reshape(n, bins)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` values; bands of other numbers differ."""
    n, bins = signature.shape
    weights = mix(np.arange(1, rows + 1, dtype=U) * _SALT) | U(1)
    bands = (signature.reshape(n, bins // rows, rows) * weights).sum(2, dtype=U)
    return mix(bands + np.arange(bins // rows, dtype=U) * _SALT)
