"""Near-dedup, substring dedup and byte dedup against brute force on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.epsilon_grid import link_embeddings, recursive_pairs
from quire.llm.minhash_dedup import _alike, near_duplicates
from quire.llm.substring_dedup import parse_documents, remove_repeated_passages, rewritten_documents
from quire.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, id string, rid long, spans int, text2 string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(45))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))
        if i % 5 == 0:
            text += " " + passage[rng.randint(0, 30) :] + " " + " ".join(rng.choice(words) for _ in range(8))
        if i % 9 == 0 and rows:
            own = rows[rng.randrange(len(rows))][1].split(" ")
            own[rng.randrange(len(own))] = "edit"
            text = " ".join(own)
        if i % 11 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text))
    line = "again and again the same eleven words stand here in line\n"
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, line * 30), (n + 4, "one"), (n + 5, "one"), (n + 6, "two w\x0b w \xa0 w"), (n + 7, " ".join(rng.choice(words) for _ in range(9000)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1, "y") for i, t in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def linked(ids, near):
    """Smallest reachable id of each, and numbers of links."""
    part = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in near[a]:
                low = min(part[a], part[b])
                if (part[a], part[b]) != (low, low):
                    part[a] = part[b] = low
                    changed = True
    return part


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(spark, block):
    rows = documents()
    sets = {}
    for i, t in rows:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {i: [j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in sets}
    part = linked(list(sets), near)
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows + rows[:3] + [(None, "one"), (None, None)]), block=block).collect() if r.doc_id is not None}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), part[i], part[i] == i) for i in sets}
    assert near_duplicates(frame(spark, [])).count() == 0
    lone = near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c")])).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in lone] == [(None, None, True)] * 2


def test_repeated_passages(spark):
    rows = documents()
    width, seen, kept = 20, {}, {}
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), (i, k)) != (i, k):
                gone.update(range(k, k + width))
        kept[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    df = frame(spark, rows + [(None, rows[0][1])])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(df).collect()}
    whole = words_of(rows[0][1])
    assert got.pop(None) == (len(whole), 0, " ".join(whole))
    assert got == kept
    assert sum(k[1] for k in kept.values()) > 100
    digests = {r.doc_id: r.kept_sha256 for r in remove_repeated_passages(df, digest=True).collect() if r.doc_id is not None}
    assert digests == {i: hashlib.sha256(k[2].encode()).hexdigest() for i, k in kept.items()}
    covered = {i: set() for i in kept}
    for r in parse_documents(df).collect():
        w, other = words_of(dict(rows)[r.doc_id]), words_of(dict(rows)[r.ref])
        factor = w[r.start : r.start + r.length]
        assert r.length >= width and r.ref <= r.doc_id
        if r.length == width:  # longer ones of single windows may join several references
            assert any(other[k : k + width] == factor for k in range(len(other)))
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    assert {i: len(c) for i, c in covered.items()} == {i: k[1] for i, k in kept.items()}
    rewritten = rewritten_documents(df)
    assert rewritten.columns == df.columns
    for r in rewritten.collect():
        if r.doc_id is not None:
            text = dict(rows)[r.doc_id] or ""
            assert r.text == (text if not kept[r.doc_id][1] else kept[r.doc_id][2])
    assert remove_repeated_passages(frame(spark, [])).count() == 0
    twice = remove_repeated_passages(frame(spark, [rows[5], rows[5]])).collect()
    assert [r.n_removed for r in twice] == [0, 0]


@pytest.mark.parametrize("width", [200, 40])
def test_repeated_bytes(spark, width):
    rows = documents()
    count, expected = {}, {}
    data = {i: (t or "").encode() for i, t in rows}
    for d in data.values():
        for k in range(len(d) - width + 1):
            count[d[k : k + width]] = count.get(d[k : k + width], 0) + 1
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - width + 1):
            if count[d[k : k + width]] > 1:
                gone[k : k + width] = True
        gone = gone[: len(d)]
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        expected[i] = (len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(frame(spark, rows), width=width).collect()}
    assert got == expected
    assert sum(e[1] for e in expected.values()) > 100
    assert remove_repeated_bytes(frame(spark, [])).count() == 0
    twice = remove_repeated_bytes(frame(spark, [rows[-1], rows[-1], (None, None)]), width=width).collect()
    assert sorted((r.n_bytes, r.n_bytes - r.n_removed) for r in twice) == [(0, 0), (len(data[rows[-1][0]]), 0), (len(data[rows[-1][0]]), 0)]


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        if i % 3 == 0 and rows:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=16) * 0.08
        rows.append((i, [float(x) for x in v]))
    rows += [(300, rows[5][1]), (301, [2 * x for x in rows[5][1]]), (302, rows[5][1]), (303, [-x for x in rows[5][1]])]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0, None] * 8), (405, [float("inf")] + [0.0] * 15), (406, [1.0, 2.0]), (407, [1.0, 2.0])]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = {i: [j for j in np.flatnonzero(x[k] @ x.T >= 0.95).tolist() if j != k] for k, (i, _) in enumerate(rows)}
    near = {i: [rows[j][0] for j in v] for i, v in near.items()} | {400 + k: [] for k in range(6)} | {406: [407], 407: [406]}
    part = linked(list(near), near)
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, cells string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_embeddings(df).collect()}
    assert got == {i: (len(near[i]), part[i], part[i] == i) for i in near}
    assert link_embeddings(df.limit(0)).count() == 0
    two = link_embeddings(df.where("vec_id = 3").union(df.where("vec_id = 3")).union(df.where("vec_id = 4").withColumn("vec_id", df.vec_id * None)))
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in two.collect()) == [(-1, 0, True), (3, 1, True), (3, 1, True)]


def test_late_links_on_whole_hashes():
    """Two shingles of one set whose hashes share a half: similarity 3/4, so the pair is found."""
    a, b, c = 7 << 32 | 1, 7 << 32 | 2, 9 << 32
    table = pa.RecordBatch.from_pydict({"key": [1, 1], "left": ["0", "0"], "right": ["0", "0"], "side": pa.array([0, 0], pa.int32()), "id": [1, 2], "comp": [1, 2], "items": [[a, a + 5, b], [a, a + 5, b, c]]})
    got = [tuple(r.values()) for batch in _alike(iter([table]), 75) for r in batch.to_pylist()]
    assert set(got) == {(1, 2)}


def test_near_duplicates_of_very_long_texts(spark):
    """20,000 words, linked through a text that isn't the bucket's hub."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40_000)]
    base = [rng.choice(words) for _ in range(20_000)]
    far = base[:2600] + [rng.choice(words) for _ in range(2600)] + base[5200:]
    near = base[:18_000] + [rng.choice(words) for _ in range(2000)]
    rows = [(1, " ".join(far)), (2, " ".join(base)), (3, " ".join(near)), (4, "a b")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split()) and len(w) > 4}
    alike = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    part = linked([1, 2, 3, 4], {i: [j for x in alike for j in x if i in x and j != i] for i in range(1, 5)})
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()} == part and part[3] == part[2]


@pytest.mark.parametrize("dim", [3, 24])
def test_embedding_links_across_intervals(spark, dim):
    """Over 20 intervals, a dense cluster of a third of the rows, chains between intervals."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(900, dim))
    x[:300] = rng.normal(size=dim) + rng.normal(size=(300, dim)) * 0.05
    for i in range(300, 900, 4):
        x[i] = x[rng.integers(900)] + rng.normal(size=dim) * 0.15
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    part = linked(list(range(900)), {i: np.flatnonzero(near[i]).tolist() for i in range(900)})
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_embeddings(df, interval=40, block=8).collect()}
    assert got == {i: (int(near[i].sum()), part[i]) for i in range(900)}
    low = np.array([[0.0, 0], [1, 0], [5, 0]])
    assert set(recursive_pairs(low, low + 0.5, low, low + 0.5, 0.6, True)) == {(0, 0), (0, 1), (1, 1), (2, 2)}


def test_wide_windows(spark):
    """Windows above what 12 bits hold are exact, and those above the packing are refused."""
    rng = random.Random(8)
    shared = "".join(rng.choices("abcdefgh ", k=9000))
    texts = [shared, "x" + shared[1000:8200] + "y", "".join(rng.choices("abcdefgh ", k=9000)), shared[:5999], None]
    width = 6000
    starts = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - width + 1):
            starts.setdefault(t[k : k + width], []).append((i, k))
    gone = [set() for _ in texts]
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + width))
    got = {r.doc_id: r.n_removed for r in remove_repeated_bytes(frame(spark, list(enumerate(texts))), width=width).collect()}
    assert got == {i: len(g) for i, g in enumerate(gone)} and got[0] == 7200
    with pytest.raises(ValueError):
        remove_repeated_bytes(frame(spark, list(enumerate(texts))), width=70_000)


@pytest.mark.parametrize("union", [4, 5, 8, 13, 20, 60, 200, 400])
def test_recall_of_bands(union):
    """Pairs of sets right at the threshold share one of 64 bands of 6, whatever the size of the sets."""
    from quire.llm.sketches import band_keys, one_permutation

    random, pairs = np.random.default_rng(union), 2000
    shared = -(-3 * union // 4)
    keys = random.integers(0, 2**64, (pairs, union), dtype=np.uint64)
    alone = random.integers(0, union - shared + 1, pairs)  # of the rest, those that are only the first set's

    def bands(sets):
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        return band_keys(one_permutation(np.concatenate([np.sort(x) for x in sets]), at, 64 * 6), 6)

    one = bands([keys[i, : shared + alone[i]] for i in range(pairs)])
    two = bands([np.concatenate([keys[i, :shared], keys[i, shared + alone[i] :]]) for i in range(pairs)])
    assert (one == two).any(1).mean() >= 0.999
