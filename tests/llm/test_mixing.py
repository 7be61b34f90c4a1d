"""Mixing: targets against the excess reshared step by step, and sums of taken words against targets."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm.mixing import SOFT, mix_documents, mix_sources
from quire.llm.queries import op3_entropy_mixing, table

WEIGHTS = (1, 2, 3)


def plain_targets(sizes):
    """Targets by resharing what is above a cap until nothing is."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(ranked)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        shared = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / shared for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def rows():
    text = lambda n: " ".join(["wörd"] * n)
    out = [(i, text(1 + i * 7 % 40), "abc"[i % 3] if i % 10 else None) for i in range(400)]
    out += [(1000 + i, text(50), "hot") for i in range(900)]
    return out + [(5000, None, "a"), (5001, "", "b"), (5002, " \t\n\x0b", "empty"), (5003, "x\xa0y z", "tiny"), (None, "one two", "c"), (7, text(3), "a"), (7, text(3), "a")]


@pytest.mark.parametrize("group", [8192, 100])
def test_mix(spark, group):
    data = rows()
    df = spark.createDataFrame([(*r, 1.5, 9) for r in data], "doc_id long, text string, source string, rate double, size int")
    got = mix_sources(df, group=group).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += words(t)
    target = plain_targets(dict(sizes))
    by_target, taken = {}, Counter()
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        by_target.setdefault((r.source_size, round(r.target, 6)), Counter())["taken"] += r.taken
    source = {(i, words(t)): s for i, t, s in data}
    for r in got:
        s = source[r.doc_id, r.size] if r.doc_id is not None else "c"
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], abs_tol=1e-6)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 100 * math.ceil(len(data) / group), s
    again = mix_sources(df.repartition(7), group=group).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_rates_solve_the_dual(spark):
    """Sources meet their targets, and the tilt by language and length is what their misses call for."""
    langs = {"a": "xy", "b": "yz", "c": "x"}
    data = [(i, "w " * (i % 9 + 1) * (1 + i % 4), "abc"[i % 3], langs["abc"[i % 3]][i // 3 % len(langs["abc"[i % 3]])]) for i in range(300)]
    got = {r.id: r for r in mix_documents(spark.createDataFrame(data, "doc_id long, text string, source string, lang string")).collect()}
    total = sum(r.size for r in got.values())
    for s in "abc":
        own = [r for r in got.values() if r.source == s]
        assert math.isclose(sum(r.rate * r.size for r in own), own[0].target, rel_tol=1e-6)
    by = Counter()
    for r in got.values():
        by[r.language] += r.size
    names = sorted(by, key=lambda n: (-by[n], n))[:-1]
    mean = sum(r.size * math.log(r.size) for r in got.values()) / total
    spread = math.sqrt(sum(r.size * math.log(r.size) ** 2 for r in got.values()) / total - mean**2)
    x = {i: np.array([(r.language == n) - by[n] / total for n in names] + [(math.log(r.size) - mean) / spread]) for i, r in got.items()}
    dual = -sum(r.rate * r.size * x[i] for i, r in got.items()) / (SOFT * total)
    assert np.abs(dual).max() > 0.01  # the constraints couple the sources
    for s in "abc":
        level = [math.log(r.rate) - x[i] @ dual for i, r in got.items() if r.source == s and r.rate < 3 - 1e-9]
        assert max(level) - min(level) < 1e-3
    plain = {s: next(r.target / r.source_size for r in got.values() if r.source == s) for s in "abc"}
    miss = lambda rate: np.abs(sum(rate(r) * r.size * x[i] for i, r in got.items())).sum()
    assert miss(lambda r: r.rate) < 0.5 * miss(lambda r: plain[r.source])


def test_hot_repeated_rows(spark):
    """A third of the rows are one document: they are one entry, and copies sum up all the same."""
    data = [(1, "a b c d", "x", "en")] * 500 + [(i, "w " * (i % 50 + 1), "xyz"[i % 3], "en") for i in range(2, 1000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    got = mix_sources(df).collect()
    assert len(got) == len(data) and max(r.copies for r in got) <= 3
    assert len({r.copies for r in got if r.doc_id == 1}) <= 2
    assert mix_documents(df).where("id = 1").count() == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in mix_sources(none).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    sizes, taken, targets = Counter(), Counter(), {}
    source = {r.doc_id: (r.source, words(r.text)) for r in table(spark, sf, "documents").collect()}
    for s, n in source.values():
        sizes[s] += n
    expected = plain_targets(dict(sizes))
    for r in op3_entropy_mixing(spark, sf).collect():
        s, n = source[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.taken <= 3 * n
        taken[s] += r.taken
        targets[s] = r.target
    for s in sizes:
        assert math.isclose(targets[s], expected[s], rel_tol=1e-9)
        assert abs(taken[s] - expected[s]) <= 0.02 * expected[s] + 50
