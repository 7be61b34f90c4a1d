"""Suffix-array dedup by distributed prefix doubling over bytes.

Prefix doubling ranks positions by their first h bytes, then by pairs of ranks, at the
position and h further on, and so on until ranks are unique or h is past the threshold.
Positions whose rank is unique drop out of each round.

1. The first round ranks a sample of positions that equal strings of ``width`` bytes are
   sure to share (see ``repeats``) by 32 bytes.  A string whose sampled position drops out
   is unique, so every position of the corpus is judged.
2. Positions around a sampled one that is left are packed in a run, which is ranked by all
   bytes that its strings span: equal runs repeat as a whole.
3. Where one first rank has several such runs, positions are packed by eight.  Their ranks
   double: h grows from a quarter to a half and all of the ``width`` - 7 bytes that eight
   strings share, each the rank of a pair of ranks of half the length.
4. Groups of eight that are left are ranked by all bytes they span, and single positions
   in those that differ by the pair of ranks of half the ``width``.

Ranks are fingerprints: two positions have equal ranks if their bytes are equal, and
counting a rank's positions needs a grouping and no total order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import anchors, apply_spans, byte_units, covered, parts_of, repeated, snippets, span_end, span_start, windows_of, with_spans
from .shared import Tables

#: Bytes of the first ranks; any value up to the width gives the same result.
SEED_BYTES = 32


def duplicate_spans(docs: DataFrame, tables: Tables, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The table of texts (rid, id, text), and spans (rid, own, start, end) of bytes that repeat, own being the text's id."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(F.xxhash64("id", "text").alias("rid"), "id", "text")
    found = tables.keep(anchors(base, byte_units, width, min(SEED_BYTES, width)), "anchors")
    span = [F.col("id").alias("own"), span_start(F.col("span")).alias("start"), span_end(F.col("span"), width).alias("end")]
    whole = [tables.keep(found.where("n = 0").select("rid", *span), "inside")]

    def runs(rows: DataFrame, name: str) -> DataFrame:
        """Sorts runs with a repeated seed out by all they span; returns those to take apart, one of each kind, with weight 2 if it repeats."""
        shared = tables.keep(repeated(rows), f"{name}-shared")
        index = tables.keep(shared.groupBy("seed", "block").agg(F.sum("n").alias("total"), F.min(F.struct("rid", "id")).alias("first")), f"{name}-index")
        placed = tables.keep(shared.join(index, ["seed", "block"]), f"{name}-placed")
        tables.drop(rows, shared, index)
        whole.append(tables.keep(placed.where("total > 1").select("rid", *span), f"{name}-whole"))
        first = placed.where(F.struct("rid", "id").eqNullSafe(F.col("first")))
        unclear = first.select("seed", "block").distinct().groupBy("seed").agg(F.count("*").alias("blocks")).where("blocks > 1")
        apart = first.join(unclear.select("seed"), "seed", "left_semi").withColumn("weight", F.least("total", F.lit(2)).cast("int"))
        apart = tables.keep(apart.drop("seed", "block", "n", "total", "first").distinct(), f"{name}-open")
        tables.drop(placed)
        return apart

    blocks = runs(found, "runs")
    pieces = tables.keep(snippets(with_spans(base, blocks), width), "pieces")
    packed = tables.keep(repeated(parts_of(pieces, width), "rank").drop("rank"), "half")
    parts = runs(packed, "packed")  # by the rank of all that eight strings share
    listed = parts.groupBy("rid", F.col("id").alias("own"), F.col("block_span").alias("s")).agg(F.collect_list(F.struct("span", F.col("weight").cast("long").alias("weight"))).alias("spans"))
    texts = pieces.select("rid", "id", F.col("span").alias("s"), "text").join(listed.withColumnRenamed("rid", "key").withColumnRenamed("s", "t"), (F.col("rid") == F.col("key")) & (F.col("s") == F.col("t")) & F.col("id").eqNullSafe(F.col("own")))
    texts = texts.select("rid", "id", "text", span_start(F.col("s")).alias("from"), "spans")
    single = tables.keep(windows_of(texts, byte_units, width, False), "single")
    again = single.groupBy("one", "two").agg(F.sum("weight").alias("n")).where("n > 1").select("one", "two")
    late = single.where("weight = 1").join(again, ["one", "two"], "left_semi")
    whole.append(late.select("rid", F.col("id").alias("own"), "start", (F.col("start") + width).alias("end")))
    return base, tables.keep(functools.reduce(DataFrame.union, whole), "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        spans = batch.column(2)
        for i, text in enumerate(batch.column(1)):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            gone = covered(spans[i].values if spans[i].is_valid else None, len(data))
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(data), int(gone.sum()), n_spans, data[~gone].tobytes()))
        n, gone, runs, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut in _cut(batches):
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in cut.column(4)]
        yield pa.RecordBatch.from_arrays([*cut.columns[:4], pa.array(digest)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, digest: bool = False) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans and kept (or, with ``digest``, kept_sha256).

    Texts are UTF-8 bytes.  Each byte is removed that a string of ``width`` bytes covers
    which also starts anywhere else, in this text or another; matches never cross texts and
    are judged on the input.  n_spans counts the maximal removed runs; kept holds the
    remaining bytes (which need not be UTF-8).

    A null text counts as empty.  Rows with a null id are documents like others.  A row
    that stands twice in the table is a copy of itself, so its bytes are removed.  Texts
    shorter than ``width`` stay whole.  Other columns are ignored; an empty table gives an
    empty result.
    """
    base, spans = duplicate_spans(docs, Tables(docs.sparkSession), id_col, text_col, width)
    last = "kept_sha256 string" if digest else "kept binary"
    return apply_spans(base, spans, _digest if digest else _cut, f"id long, n_bytes long, n_removed long, n_spans long, {last}").withColumnRenamed("id", id_col)
