"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the whole corpus, cut into blocks by content (see ``repeats``), each of
which is indexed with its first place: the smallest id and start that have it.  A text is
factored against the index from left to right.  A factor begins at a block that the index
has from an earlier place, and takes the blocks behind it as long as the reference goes on
where the factor does; blocks overlap, so none of its windows is missed.  Factors of at
least ``width`` words are duplicate spans.

Where the parse breaks off, that is at blocks that the index has not as a whole but whose
seed it knows, the single windows across the factors' boundaries are looked up, each of
which is a factor of its own.  So a word goes exactly if one of its windows stands earlier.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import anchors, apply_spans, repeated, span_end, span_start, windows_of, with_spans, word_units
from .shared import Tables

#: Words of a seed; any value up to the window's width gives the same result.
SEED_WORDS = 4


def duplicate_spans(docs: DataFrame, tables: Tables, id_col: str, text_col: str, width: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table of texts (rid, id, text and, with ``carry``, a struct of those columns), and blocks and windows (rid, own, start, end, ref, shift) of words with an earlier copy; own is the text's id."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*carry).alias("carry")] if carry else []))
    base = base.withColumn("rid", F.xxhash64("id", "text"))
    found = tables.keep(anchors(base.where("id is not null").select("rid", "id", "text"), word_units, width, SEED_WORDS), "anchors")
    shared = tables.keep(repeated(found), "shared")
    start, end = span_start(F.col("span")), span_end(F.col("span"), width)
    index = tables.keep(shared.groupBy("seed", "block").agg(F.min(F.struct(F.col("id").alias("id"), start.alias("start"))).alias("first")), "index")
    unclear = index.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    placed = tables.keep(shared.join(index, ["seed", "block"]).select("rid", "id", "span", "seed", "first"), "parse")
    tables.drop(shared)
    span = [F.col("id").alias("own"), start.alias("start"), end.alias("end")]
    blocks = placed.where("id > first.id").select("rid", *span, F.col("first.id").alias("ref"), (F.col("first.start") - start).alias("shift"))
    blocks = blocks.union(found.where("n = 0").select("rid", *span, F.col("id"), F.lit(None).cast("long")))
    open_blocks = tables.keep(placed.where("id = first.id").join(unclear, "seed", "left_semi").select("rid", "id", "span", F.lit(1).alias("weight")).distinct(), "boundaries")
    single = tables.keep(windows_of(with_spans(base, open_blocks), word_units, width, True), "windows")
    earliest = single.where("weight = 1").groupBy("one", "two").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    late = single.where("weight = 1").join(earliest, ["one", "two"]).where("id > first").select("rid", "id", "start", "first")
    late = late.union(single.where("weight = 0").select("rid", "id", "start", "id"))
    windows = late.select("rid", F.col("id").alias("own"), "start", (F.col("start") + width).alias("end"), F.col("first").alias("ref"), F.lit(None).cast("long").alias("shift"))
    spans = tables.keep(blocks.union(windows), "spans")
    tables.drop(found, index, placed, open_blocks, single)
    return base, spans


def factors_of(spans: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of one text: starts, ends and references (ids) of its factors of at least ``width`` words.

    A factor goes on while the next block overlaps it and stands at the same distance in the
    same reference; single windows (without a distance) go on in any way.
    """
    start, end, ref = (spans.field(c).to_numpy() for c in ("start", "end", "ref"))
    shift = spans.field("shift").fill_null(np.iinfo(np.int64).max).to_numpy()
    order = np.lexsort((end, start))
    start, end, ref, shift = start[order], end[order], ref[order], shift[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > np.maximum.accumulate(end)[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])
    at = np.flatnonzero(new)
    start, end, ref = start[at], np.maximum.reduceat(end, at), ref[at]
    long_enough = end - start >= width
    return start[long_enough], end[long_enough], ref[long_enough]


def _gone(spans: pa.StructScalar, n: int, width: int) -> np.ndarray:
    """Which of n words the factors cover."""
    step = np.zeros(n + 1, np.int64)
    start, end, _ = factors_of(spans.values, width)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _factors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(2)[i].is_valid:
                start, end, ref = factors_of(batch.column(2)[i].values, width)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(start), pa.int64()), pa.array(start), pa.array(end - start), pa.array(ref)], ["id", "start", "length", "ref"])


def parse_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """The factors of at least ``width`` words: id, start, length (words) and ref, the id of a text that has it earlier."""
    base, spans = duplicate_spans(docs, Tables(docs.sparkSession), id_col, text_col, width, [])
    return apply_spans(base, spans, functools.partial(_factors, width=width), "id long, start long, length long, ref long").withColumnRenamed("id", id_col)


def _apply(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        spans = batch.column(2)
        for i, text in enumerate(batch.column(1)):
            words = text.as_buffer().to_pybytes().split()
            gone = _gone(spans[i], len(words), width) if spans[i].is_valid else None
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            kept.append(b" ".join(words if gone is None else compress(words, (~gone).tolist())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def _rewritten(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Carried columns, removed words and texts; those without removals stay as they are."""
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes()
            words = data.split() if spans.is_valid else ()
            gone = _gone(spans, len(words), width) if spans.is_valid else None
            removed = 0 if gone is None else int(gone.sum())
            rows.append((removed, data if not removed else b" ".join(compress(words, (~gone).tolist()))))
        yield pa.RecordBatch.from_arrays([batch.column(3), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())], ["carry", "n_removed", "text"])


def rewritten_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, their texts without the repeated passages.

    Texts from which nothing is removed stay as they are, in others the kept words are
    joined by one space.  Rows that lose all their words go.
    """
    others = [c for c in docs.columns if c != text_col]
    base, spans = duplicate_spans(docs, Tables(docs.sparkSession), id_col, text_col, width, others)
    out = apply_spans(base, spans, functools.partial(_rewritten, width=width), base.select("carry").withColumns({"n_removed": F.lit(0).cast("long"), "text": F.lit("")}).schema)
    out = out.where("n_removed = 0 or text <> ''")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("carry")[c].alias(c) for c in docs.columns))


def _digest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for kept in _apply(batches, width):
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in kept.column(3)]
        yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(digest)], ["id", "n_words", "n_removed", "kept_sha256"])


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, digest: bool = False) -> DataFrame:
    """One row a document: id, n_words, n_removed and kept_text (or, with ``digest``, kept_sha256).

    Words are runs without the characters 0x20 and 0x09-0x0D.  Each word is removed that a
    window of ``width`` words covers whose words also start earlier: in a text of smaller
    id, or before it in the same text.  Windows are judged on the input.  The kept words are
    joined by one space.

    A null text counts as empty.  Rows with a null id are kept whole and are nobody's
    earlier copy.  Rows that repeat an id and its text get equal results and don't count
    as each other's copies; nor do rows of one id with different texts.  Texts shorter than
    a window stay whole.  Other columns are ignored; an empty table gives an empty result.
    """
    base, spans = duplicate_spans(docs, Tables(docs.sparkSession), id_col, text_col, width, [])
    last = "kept_sha256" if digest else "kept_text"
    out = apply_spans(base, spans, functools.partial(_digest if digest else _apply, width=width), f"id long, n_words long, n_removed long, {last} string")
    return out.withColumnRenamed("id", id_col)
