"""The trie of conversations' prefixes, from a global sort of turn arrays.

1. A turn is a symbol of 20 bytes: the digest of its role and text, and the text's length.
   A conversation is the string of its symbols; texts don't leave the first stage.
2. Conversations are range-sorted by (symbols, id).  A prefix's members are then neighbours
   wherever the order of symbols puts them.
3. A task sweeps its range with a stack: the symbols that a conversation has in common with
   the one before (the LCP) stay open, deeper nodes are closed, and its own ones are opened.
   A closed node is complete, as its members are an LCP interval, unless it lies on the path of
   the range's first conversation or is still open at its end; such nodes go out as pieces.
4. Pieces, two paths a range, are stitched in order by a second sweep with the same stack.
5. Ids that end at a node are in order; those of a node that has many, or that lies in pieces,
   go out in chunks, and a node's chunks are digested as a stream.

A task holds one path of open nodes, and at most CHUNK ids of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, broadcast_if_small

#: Bytes of a symbol, and of the text's length at its end.
SYMBOL, LENGTH = 20, 4
#: Ids of a chunk of a node's ends.
CHUNK = 4_096
#: Conversations whose heads are replaced: their number, and the most turns a head has.
GROUP, HEADS = 100, 6


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, symbols array<string>): each conversation's symbols in hexadecimal, by turn (null first), then role, then symbol."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbol = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.lower(F.hex(F.length(text))), 2 * LENGTH, "0"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), symbol.alias("symbol")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["symbol"]).alias("symbols"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, symbols) with the first h symbols of each conversation those of its group's first one, h being crc32(id) % 6."""
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head_id"), F.slice("symbols", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.join(broadcast_if_small(heads, row_bytes=400), F.col("conv_id") - F.col("conv_id") % GROUP == F.col("head_id"), "left")
    first = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    return both.select("conv_id", F.concat(first, F.slice("symbols", h + 1, F.size("symbols"))).alias("symbols"))


class _Node:
    __slots__ = ("depth", "hash", "least", "n", "children", "leaves", "saved", "length", "n_ends", "ids", "chunks", "first")

    def __init__(self, depth: int, own: bytes, length: int, first: bool):
        self.depth, self.hash, self.length, self.first = depth, own, length, first
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.n_ends, self.ids, self.chunks = 0, [], 0

    def add(self, least: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def complete(self) -> tuple[int, int]:
        """Leaves and savings of the whole subtree."""
        return self.leaves or 1, self.saved + (self.n - 1) * self.length

    def join(self, parent: "_Node") -> None:
        parent.add(self.least, self.n, 1, *self.complete())


_EMPTY = hashlib.sha256(b"").hexdigest()
#: node: complete; piece: a part of one, with own sums; chunk: ids that end at a node.
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("later", pa.bool_()), ("seq", pa.int64()), ("hash", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("length", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.binary()),
])
_DDL = "kind string, part int, later boolean, seq long, hash binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, length long, n_ends long, ends_sha256 string, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _common(a: bytes, b: bytes) -> int:
    """Symbols that two keys begin with."""
    if b.startswith(a):
        return len(a) // SYMBOL
    n = 0
    while a[n : n + SYMBOL] == b[n : n + SYMBOL]:
        n += SYMBOL
    return n // SYMBOL


class _Sweep:
    """The stack of one sorted range; ``out`` has the rows that are ready."""

    def __init__(self, part: int):
        self.part, self.stack, self.out, self.before = part, [], [], b""

    def flush(self, node: _Node) -> None:
        ids = ",".join(map(str, node.ids)).encode()
        self.out.append(("chunk", self.part, False, node.chunks, node.hash, None, node.depth, None, None, 0, 0, 0, 0, 0, 0, None, ids))
        node.chunks, node.ids = node.chunks + 1, []

    def piece(self, node: _Node) -> None:
        if node.ids:
            self.flush(node)
        self.out.append(("piece", self.part, not node.first, 0, node.hash, None, node.depth, node.least, None, node.n, node.children, node.leaves, node.saved, node.length, node.n_ends, None, None))

    def close(self, depth: int) -> None:
        """Closes what is deeper.  A node's row waits for its parent, and goes out without the parent's smallest id where that stays open."""
        waiting = None
        while len(self.stack) > depth + 1:
            node, parent = self.stack.pop(), self.stack[-1]
            if waiting is not None:
                self.out.append(waiting if node.first else (*waiting[:8], node.least, *waiting[9:]))
                waiting = None
            if node.first:
                self.piece(node)
                continue
            digest = None
            if node.chunks and node.ids:
                self.flush(node)
            elif not node.chunks:
                digest = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest() if node.ids else _EMPTY
            node.join(parent)
            leaves, saved = node.complete()
            waiting = ("node", self.part, False, 0, node.hash, parent.hash, node.depth, node.least, None, node.n, node.children, leaves, saved, node.length, node.n_ends, digest, None)
        if waiting is not None:
            self.out.append(waiting)

    def add(self, key: bytes, conv: int) -> None:
        first = not self.stack
        if first:
            self.stack.append(_Node(0, b"", 0, True))
        common = _common(self.before, key)
        self.close(common)
        for at in range(common * SYMBOL, len(key), SYMBOL):
            symbol = key[at : at + SYMBOL]
            self.stack.append(_Node(len(self.stack), hashlib.md5(self.stack[-1].hash + symbol).digest(), int.from_bytes(symbol[-LENGTH:], "big"), first))
        node = self.stack[-1]
        node.add(conv, 1, 0, 0, 0)
        node.n_ends += 1
        node.ids.append(conv)
        if len(node.ids) == CHUNK:
            self.flush(node)
        self.before = key

    def end(self) -> None:
        for node in self.stack:
            self.piece(node)
        self.stack = []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sweep.add(key, conv)
            if len(sweep.out) >= 10_000:
                yield _batch(sweep.out)
                sweep.out = []
    sweep.end()
    yield _batch(sweep.out)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins pieces, sorted by range, the first path before the last one, and depth."""
    stack: list[_Node] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            node = stack.pop()
            parent = stack[-1] if stack else None
            leaves, saved = node.complete()
            if parent is not None:
                node.join(parent)
            out.append(("stitched", 0, False, 0, node.hash, parent.hash if parent else None, node.depth, node.least, None, node.n, node.children, leaves, saved, node.length, node.n_ends, None if node.n_ends else _EMPTY, None))

    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if len(stack) > d and stack[d].hash == r["hash"]:
                node = stack[d]
            else:
                close(d - 1)
                node = _Node(d, r["hash"], r["length"], False)
                stack.append(node)
            node.add(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            node.n_ends += r["n_ends"]
        yield _batch(out)
        out = []
    close(-1)
    yield _batch(out)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's chunks, which come in order."""
    now, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([total.hexdigest()])], ["end_hash", "digest"])

    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != now:
                if total is not None:
                    yield row()
                now, total = own, hashlib.sha256()
            else:
                total.update(b",")
            total.update(ids)
    if total is not None:
        yield row()


def prefix_trie(arrays: DataFrame, tables: Tables) -> DataFrame:
    """One row a node of the trie of ``arrays`` (conv_id, symbols): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    keys = arrays.select(F.unhex(F.array_join("symbols", "")).alias("key"), "conv_id")
    rows = tables.keep(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_sweep, _DDL), "sweep")
    pieces = rows.where("kind = 'piece'").repartition(1).sortWithinPartitions("part", "later", "depth")  # two paths a range
    stitched = tables.keep(pieces.mapInArrow(_stitch, _DDL), "stitched")
    chunks = rows.where("kind = 'chunk'").select("hash", "ids", "part", "seq").repartition("hash").sortWithinPartitions("hash", "part", "seq")
    digests = tables.keep(chunks.mapInArrow(_ends, "end_hash binary, digest string"), "ends")
    nodes = rows.where("kind = 'node'")
    parents = nodes.where("n_children > 1").union(stitched).select(F.col("hash").alias("parent_hash"), F.col("conv_id").alias("of_parent"))
    whole = nodes.union(stitched)
    # A node in a row with its parent's id has ends of its own, or none, so both joins are few rows.
    done = whole.where("parent_conv_id is not null and ends_sha256 is not null").withColumn("digest", F.lit(None).cast("string")).withColumn("of_parent", F.lit(None).cast("long"))
    rest = whole.where("parent_conv_id is null or ends_sha256 is null")
    rest = rest.join(broadcast_if_small(parents, row_bytes=60), F.col("parent") == F.col("parent_hash"), "left")
    rest = rest.join(broadcast_if_small(digests, row_bytes=140), (F.col("hash") == F.col("end_hash")) & F.col("ends_sha256").isNull(), "left")
    columns = ["conv_id", "depth", F.coalesce("parent_conv_id", "of_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "digest").alias("ends_sha256")]
    return done.select(*columns).union(rest.select(*columns))


def conversation_trie(conversations: DataFrame, shared_heads: bool = True) -> DataFrame:
    """One row a node of the prefix trie of ``conversations`` (conv_id, turn, role, text).

    With ``shared_heads`` a conversation c starts with the first h turns of conversation
    c - c % 100 in place of its own, h being crc32 of c's decimal digits % 6: fewer if that one has
    fewer, none if it isn't there.  Columns: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (code
    points that sharing the subtree's texts saves) and ends_sha256 (of the decimal ids of
    members that end there, ascending, joined by commas).

    Null turns come first; turns that tie are in order of role, then of a digest.  A null role or
    text is "".  Rows that repeat are turns like others.  Rows with a null conv_id belong to no
    conversation.  A conversation without turns ends at the root.  Other columns are
    ignored; an empty table gives an empty result.  Equal turns are told by 128 bits.  A
    task needs some 200 bytes for each turn of its longest conversation.
    """
    tables = Tables(conversations.sparkSession)
    own = tables.keep(turn_arrays(conversations), "own")
    return prefix_trie(rebuilt(own) if shared_heads else own, tables)
