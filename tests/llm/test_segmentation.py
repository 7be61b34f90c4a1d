"""Sampled segmentations: exact round trips, and distribution against all segmentations of a short text."""

import math
from collections import Counter
from functools import lru_cache

import numpy as np

from quire.llm.queries import op2_sentencepiece_sampling
from quire.llm.segmentation import decode_ids, decode_segmentations, default_model, pieces_of, sample_segmentations, sample_slice


def all_paths(text, pieces):
    """Every segmentation of a text whose characters are all pieces, with its probability."""
    data = (" " + text).encode()
    own = {t: i for i, t in enumerate(pieces.text) if t and i not in set(pieces.bytes_id.tolist())}

    @lru_cache(None)
    def paths(at):
        if at == len(data):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, min(len(data), at + pieces.longest) + 1):
            i = own.get(data[at:end])
            if i is not None:
                out += [((i, *rest), float(pieces.log[i]) + log) for rest, log in paths(end)]
        return out

    found = {p: log for p, log in paths(0)}
    total = np.logaddexp.reduce(list(found.values()))
    return {p: math.exp(log - total) for p, log in found.items()}


def samples(text, n, k, pieces):
    data = np.frombuffer(text.encode() * n, np.uint8)
    offsets = np.arange(n + 1) * len(text.encode())
    keys = np.random.default_rng(9).integers(0, 1 << 63, n).astype(np.uint64)
    return sample_slice(data, offsets, keys, pieces, k)


def test_first_sample_follows_the_distribution():
    pieces = pieces_of(default_model())
    exact = all_paths("the", pieces)
    assert len(exact) > 2
    n = 4000
    got = Counter(tuple(s[0][0].tolist()) for s in samples("the", n, 1, pieces))
    assert set(got) <= set(exact)
    for path, p in exact.items():
        assert abs(got[path] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_samples_are_distinct_and_ordered():
    pieces = pieces_of(default_model())
    exact = all_paths("the", pieces)
    for found in samples("the", 200, len(exact) + 3, pieces):
        paths = [tuple(ids.tolist()) for ids, *_ in found]
        assert len(set(paths)) == len(paths) and set(paths) <= set(exact)
        values = [v for _, _, v, _ in found]
        assert values == sorted(values, reverse=True)
        for path, (_, log, _, inclusion) in zip(paths, found):
            assert math.isclose(math.exp(log), exact[path], rel_tol=1e-6) and 0 <= inclusion <= 1
        if len(found) == len(exact):
            assert all(i == 1.0 for *_, i in found)


def test_second_sample_is_without_replacement():
    """The chance that a path is among the first two, against the sum over ordered draws."""
    pieces = pieces_of(default_model())
    exact, n = all_paths("an", pieces), 4000
    got = Counter(tuple(ids.tolist()) for s in samples("an", n, 2, pieces) for ids, *_ in s)
    for path, p in exact.items():
        both = p + sum(q * p / (1 - q) for other, q in exact.items() if other != path)
        assert abs(got[path] / n - both) < 4 * math.sqrt(both * (1 - both) / n) + 2e-3


def test_round_trip(spark):
    texts = ["Hello world", "  two  spaces ", "tab\tnew\nline\r\n", "naïve 日本語 😀 ​\x00", "", None, "a", "x" * 3000, "word " * 30_000, "▁ mark", "Hello world"]
    df = spark.createDataFrame([(i, t, "q", 2) for i, t in enumerate(texts)] + [(None, "no id", "q", 2)], "doc_id long, text string, ids string, sample int")
    got = sample_segmentations(df, k=3)
    back = decode_segmentations(got).collect()
    by = {i: t or "" for i, t in enumerate(texts)} | {None: "no id"}
    assert all(r.text == by[r.doc_id] for r in back) and {r.doc_id for r in back} == set(by)
    rows = got.collect()
    for i in by:
        own = [r for r in rows if r.doc_id == i]
        assert len({tuple(r.ids) for r in own}) == len(own) <= 3
        assert sorted(r["sample"] for r in own) == list(range(len(own)))
    assert [len(r.ids) for r in rows if r.doc_id in (4, 5)] == [0, 0]
    again = sample_segmentations(df.repartition(5), k=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sample_segmentations(df.limit(0)).count() == 0 and decode_segmentations(got.limit(0)).count() == 0


def test_query_round_trips_everything(spark):
    got = op2_sentencepiece_sampling(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.round_trip for r in got)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_decode_any_bytes():
    pieces = pieces_of(default_model())
    ids = pieces.bytes_id[np.frombuffer(b"\xff\x00a", np.uint8)]
    assert decode_ids(ids, pieces) == b"\xff\x00a"
