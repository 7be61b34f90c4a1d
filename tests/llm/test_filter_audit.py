"""The walk over all orders against plain counting, and the audit over awkward rows."""

import itertools
import math
import random
import re

from quire.llm.filter_audit import FILTERS, audit_filters, transpositions, walk

DOCS = "doc_id long, text string, lang string, source string, part string, mask int, n long"
LABELS = "doc_id long, quality int, toxic int, text string, lang string"


def plain(counts, order):
    """(kept, removed, good, toxic, redundant) of each step, document by document."""
    left, gone, out = dict(counts), {}, []
    for f in order:
        bit = 1 << FILTERS.index(f)
        now = {m: c for m, c in left.items() if m & bit}
        redundant = sum(c[0] for m, c in gone.items() if m & bit)
        left = {m: c for m, c in left.items() if not m & bit}
        gone |= now
        out.append((sum(c[0] for c in left.values()), *(sum(c[k] for c in now.values()) for k in range(3)), redundant))
    return out


def test_transpositions_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in transpositions(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_walk_is_plain_counting():
    rng = random.Random(5)
    for _ in range(20):
        counts = {m: (rng.randint(0, 50), rng.randint(0, 9), rng.randint(0, 9)) for m in range(32) if rng.random() < 0.7}
        orders, shapley = walk(counts)
        assert set(orders) == {"".join(p) for p in itertools.permutations(FILTERS)}
        total = dict.fromkeys(FILTERS, 0)
        for order, steps in orders.items():
            expected = plain(counts, order)
            assert steps == [s[:4] for s in expected]
            for f, s in zip(order, expected):
                total[f] += s[1]
        assert shapley == [total[f] for f in FILTERS]


def fails(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    conditions = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)
    return sum(1 << i for i, c in enumerate(conditions) if c)


def test_audit_of_awkward_rows(spark):
    rng = random.Random(3)
    words = [f"wörd{i}" for i in range(300)]
    texts = [None, "", " \t\r\n\x0b\x0c", "A" * 50, "one # two", "\xa0 no\xa0break", "x " * 200, " ".join(words), " ".join(words) + " $", "é" * 9 + "A", "é" * 8 + "AA"]
    texts += [" ".join(rng.choices(words, k=rng.choice((20, 99, 100, 101, 150)))) for _ in range(30)]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", "", None))) for i in range(120)]
    rows += [(None, "A" * 50, "en"), (None, "A" * 50, "en"), (5, rows[5][1], rows[5][2]), (7, rows[7][1], "fr"), (-3, " ".join(words), "en"), (200, "solo " * 20000, "xx")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, "s", "p", 1, 2) for i, t, p in rows], DOCS)
    found = audit_filters(docs, spark.createDataFrame([(i, q, t, "t", "l") for i, q, t in labels], LABELS)).collect()
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    counts = {}
    for i, t, p in rows:
        mask = fails(t or "", i is not None and least[t or ""] < i)
        n = counts.setdefault(p or "", {}).setdefault(mask, [0, 0, 0])
        n[0] += 1
        n[1] += i in good
        n[2] += i in toxic
    expected = {}
    for part, own in counts.items():
        total = dict.fromkeys(FILTERS, 0)
        for p in itertools.permutations(FILTERS):
            for k, (f, s) in enumerate(zip(p, plain(own, p))):
                total[f] += s[1]
                expected[part, "".join(p), k + 1] = (*s[:2], s[4], own.get(1 << FILTERS.index(f), [0])[0], s[2], s[3], f)
        for p in itertools.permutations(FILTERS):
            for k in range(5):
                at = (part, "".join(p), k + 1)
                expected[at] = (*expected[at][:-1], total[expected[at][-1]])
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found) and got == expected


def test_no_rows_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(docs, labels).count() == 0
    rows = audit_filters(spark.createDataFrame([(1, "a", "en", "s", "p", 1, 2)], DOCS), labels).collect()
    assert len(rows) == 600 and {r.removed for r in rows if r.filter_order[r.step - 1] == "A"} == {1}
