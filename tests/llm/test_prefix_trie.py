"""The prefix trie against a dictionary of prefixes, over one range and over many."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import prefix_trie as P
from quire.llm.shared import Tables

SCHEMA = "conv_id long, turn long, role string, text string, key string, hash string, part int"


def own_turns(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    symbol = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    return {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: (*x[:3], symbol(*x[2:])))] for c, turns in out.items()}


def expected(rows, shared_heads=True):
    own, nodes = own_turns(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if shared_heads else 0
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = (own.get(head, [])[:h] if h else []) + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    children, out = {}, []
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        parent = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(c for c, _ in members), len(k), parent, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, hot=0.4):
    rng, rows = random.Random(seed), []
    for c in range(n):
        if rng.random() < 0.05:
            continue
        if rng.random() < hot:
            rows += [(c, t, "user", f"häufig {t}") for t in range(7)]
            continue
        for t in range(rng.choice((1, 2, 3, 3, 8, 20))):
            rows.append((c, rng.choice((t, t, t, None, 1)), rng.choice(("user", "assistant", None, "")), rng.choice(("a", "b", "", None, "ab😀"))))
    return rows + [(None, 1, "user", "no id"), (-5, 0, "user", "below"), (-100, 0, "user", "head"), (-105, 3, None, "x")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "h", 3) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(seed, 350)
    assert got(P.conversation_trie(frame(spark, rows))) == expected(rows)
    assert got(P.conversation_trie(frame(spark, rows), shared_heads=False)) == expected(rows, False)


@pytest.mark.parametrize("parts,chunk", [(1, 3), (2, 4096), (7, 2), (40, 5), (40, 4096)])
def test_sweeps_of_many_ranges(parts, chunk, monkeypatch):
    """Ranges of any cut give the same nodes: the sweep and the stitch without Spark."""
    monkeypatch.setattr(P, "CHUNK", chunk)
    rows = conversations(9, 250, hot=0.5)
    own = own_turns(rows)
    symbol = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() + len(t).to_bytes(4, "big")
    keys = sorted((b"".join(symbol(*t) for t in turns), c) for c, turns in own.items())
    rng = random.Random(parts)
    cuts = [0, *sorted(rng.randint(0, len(keys)) for _ in range(parts - 1)), len(keys)]
    out = []
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        sweep = P._Sweep(p)
        for key, c in keys[a:b]:
            sweep.add(key, c)
        sweep.end()
        out += sweep.out
    names = [f.name for f in P._SCHEMA]
    swept = [dict(zip(names, r)) for r in out]
    pieces = sorted((r for r in out if r[0] == "piece"), key=lambda r: (r[1], r[2], r[6]))
    stitched = [r for batch in P._stitch(iter([P._batch(pieces)])) for r in batch.to_pylist()]
    chunks = {}
    for r in sorted((r for r in swept if r["kind"] == "chunk"), key=lambda r: (r["part"], r["seq"])):
        chunks.setdefault(r["hash"], []).append(r["ids"])
    nodes = [r for r in swept if r["kind"] == "node"] + stitched
    assert len({r["hash"] for r in nodes}) == len(nodes)
    least = {r["hash"]: r["conv_id"] for r in nodes}
    rows_out = []
    for r in nodes:
        parent = r["parent_conv_id"] if r["parent_conv_id"] is not None else least.get(r["parent"])
        digest = r["ends_sha256"] or hashlib.sha256(b",".join(chunks[r["hash"]])).hexdigest()
        rows_out.append((r["conv_id"], r["depth"], parent, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], digest))
    assert sorted(rows_out, key=str) == expected(rows, False)


def test_awkward_tables(spark, monkeypatch):
    assert P.conversation_trie(frame(spark, [])).count() == 0
    assert P.conversation_trie(frame(spark, [(None, 1, "u", "t")])).count() == 0
    same = [(c, t, "u", "x" * 5000) for c in range(300) for t in range(6)]
    assert got(P.conversation_trie(frame(spark, same))) == expected(same)
    lone = [(1, 0, "u", "t")]  # crc32("1") % 6 takes its only turn
    assert got(P.conversation_trie(frame(spark, lone))) == expected(lone)
    long = [(2, t, "u", f"{t}") for t in range(3000)] + [(3, t, "u", f"{t}") for t in range(2999)]
    assert got(P.conversation_trie(frame(spark, long), shared_heads=False)) == expected(long, False)


def test_equal_conversations_over_many_ranges(spark):
    """One sequence that fills several ranges: its ends are one digest."""
    own = spark.range(0, 20_000, numPartitions=8).select(F.col("id").alias("conv_id"), F.array(F.lit("ab" * 20), F.lit("cd" * 20)).alias("symbols"))
    tables = Tables(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = P.prefix_trie(own, tables).orderBy("depth").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.n_convs for r in rows] == [20_000] * 3
    assert rows[2].ends_sha256 == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
    assert [r.parent_conv_id for r in rows] == [None, 0, 0]
