"""Exact search for repeated windows: anchors, the blocks of windows they own, and unclear windows.

A window is ``width`` consecutive units (words or bytes) of one text.  Sorting or shuffling
every window of a corpus would move many times its size, so windows are grouped first:

* Each window is owned by the place in it whose ``seed`` units have the least hash.  Equal
  windows own the same place, so a window repeats only if the seed at its owner does.
* The windows with one owner are consecutive; the units they span are its block.  Equal
  blocks hold equal windows, so all occurrences of a block but one need no closer look.
* Only where a seed stands in several different blocks can single windows of them agree.
  Those blocks, once each, are taken apart: into windows, or first into parts of ``PART``
  windows, which are sorted out in the same way by the units all their windows share.

Rows travel with hashes, so hot seeds and blocks are counted before a shuffle.  A seed's
and a block's 64 bits are compared together, and of a window the 64 bits of each half.
Spans find their text by 64 bits of its content and its id together.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import BYTE_CODE, U, mix, prefix_sums, sampled_owners, slices, span_hash, word_spans

_SALT = U(0xA0761D6478BD642F)
#: Windows in a part of a block.
PART = 8
#: ``span`` packs a block: first start << 32 | (windows - 1) << 16 | units from there to the owner.  Both
#: numbers are at most the width less the seed.
START, COUNT, LOW = 32, 16, (1 << 16) - 1

ANCHORS = "rid long, id long, span long, seed long, block long, n int"


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    return prefix_sums(span_hash(prefix_sums(BYTE_CODE[data]), starts, ends)), first


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prefix_sums(BYTE_CODE[data]), offsets


def _anchors(batches: Iterator[pa.RecordBatch], units: Callable, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of a text; blocks that the text repeats come with their number and first place."""
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(2)):
            sums, first = units(data, offsets)
            n = len(sums) - 1
            starts = np.flatnonzero(np.arange(n) <= np.repeat(first[1:] - width, np.diff(first)))
            if not len(starts):
                continue
            begin = np.arange(n - seed + 1)
            order = span_hash(sums, begin, begin + seed)
            owner = sampled_owners(order, starts, width - seed + 1)
            lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lo, hi, place = starts[lead], starts[np.append(lead[1:], len(starts)) - 1], owner[lead]
            text = np.searchsorted(first, lo, "right") - 1
            block = mix(span_hash(sums, lo, hi + width) ^ ((place - lo).astype(U) * _SALT))
            key = mix(mix(block) ^ order[place]) + text.astype(U) * _SALT
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            again = np.ones(len(key), bool)
            again[at] = False
            n_each = np.zeros(len(key), np.int32)
            n_each[at] = count  # 0 for what the text has had before
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a).take(pa.array(text)),
                    batch.column(1).slice(a, b - a).take(pa.array(text)),
                    pa.array((lo - first[text]) << START | (hi - lo) << COUNT | place - lo),
                    pa.array(order[place].view(np.int64)),
                    pa.array(block.view(np.int64)),
                    pa.array(n_each),
                ],
                ["rid", "id", "span", "seed", "block", "n"],
            )


def anchors(base: DataFrame, units: Callable, width: int, seed: int) -> DataFrame:
    """The blocks of all texts of ``base`` (rid, id, text); see ``ANCHORS``.

    ``n`` is how often the text has the block, at its first place there, else 0.
    """
    if not 0 < seed <= width <= LOW + seed:
        raise ValueError(f"a window has {seed} to {LOW + seed} units, not {width}")
    return base.mapInArrow(functools.partial(_anchors, units=units, width=width, seed=seed), ANCHORS)


def span_start(span: Column) -> Column:
    return F.shiftright(span, START)


def span_end(span: Column, width: int) -> Column:
    """The place after the last unit of the block's windows."""
    return F.shiftright(span, START) + F.shiftright(span, COUNT).bitwiseAND(LOW) + width


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> START, (span >> COUNT & LOW) + 1, span & LOW


def _windows(batches: Iterator[pa.RecordBatch], units: Callable, width: int, once: bool) -> Iterator[pa.RecordBatch]:
    """Windows of the spans beside each text (rid, id, text, from, spans): (rid, id, start, weight, one, two).

    ``from`` is the place of the text's first unit.  With ``once``, a window that the text
    has had before has weight 0.
    """
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(2)):
            sums, first = units(data, offsets)
            own = batch.column(4).slice(a, b - a)
            packed, count = own.flatten(), np.diff(own.offsets.to_numpy())
            span, weight = packed.field(0).to_numpy(), packed.field(1).to_numpy()
            text = np.repeat(np.arange(b - a), count)
            start, size, _ = _unpack(span)
            shift = first[text] - batch.column(3).slice(a, b - a).to_numpy()[text]
            begin = np.repeat(start + shift, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text, shift, weight = np.repeat(text, size), np.repeat(shift, size), np.repeat(weight, size)
            middle = begin + width // 2
            one, two = span_hash(sums, begin, middle), span_hash(sums, middle, begin + width)
            if once:
                order = np.lexsort((begin, two, one, text))
                same = np.zeros(len(order), bool)
                same[1:] = (text[order][1:] == text[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
                weight = np.ones(len(begin), np.int64)
                weight[order[same]] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a).take(pa.array(text)),
                    batch.column(1).slice(a, b - a).take(pa.array(text)),
                    pa.array(begin - shift),
                    pa.array(weight.astype(np.int32)),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                ],
                ["rid", "id", "start", "weight", "one", "two"],
            )


def windows_of(texts: DataFrame, units: Callable, width: int, once: bool) -> DataFrame:
    """The single windows of ``texts`` (rid, id, text, from, spans); ``one`` and ``two`` are ranks of a window's halves."""
    return texts.select("rid", "id", "text", "from", "spans").mapInArrow(functools.partial(_windows, units=units, width=width, once=once), "rid long, id long, start long, weight int, one long, two long")


def with_spans(base: DataFrame, blocks: DataFrame) -> DataFrame:
    """Texts of ``base`` (rid, id, text) that have ``blocks`` (rid, id, span, weight), with their list."""
    wanted = blocks.groupBy("rid", F.col("id").alias("own")).agg(F.collect_list(F.struct("span", F.col("weight").cast("long").alias("weight"))).alias("spans"))
    return _with_texts(base, wanted, "inner").select("rid", "id", "text", F.lit(0).cast("long").alias("from"), "spans")


def _with_texts(base: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """Rows of ``base`` (rid, id, ...) beside those of ``wanted`` (rid, own, ...) with the same hash and id."""
    wanted = wanted.withColumnRenamed("rid", "key")
    return base.join(wanted, (F.col("rid") == F.col("key")) & F.col("id").eqNullSafe(F.col("own")), how).drop("key", "own")


def _snippets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(spans, pa.int64()), pa.array(weights, pa.int32()), pa.array(parts, pa.binary())], ["rid", "id", "span", "weight", "text"])

    for batch in batches:
        rids, ids, spans, weights, parts, held = [], [], [], [], [], 0
        for rid, id_, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(4)):
            data = text.as_buffer().to_pybytes()
            for span, weight in zip(own.values.field(0).to_pylist(), own.values.field(1).to_pylist()):
                rids.append(rid)
                ids.append(id_)
                spans.append(span)
                weights.append(weight)
                parts.append(data[span >> START : (span >> START) + (span >> COUNT & LOW) + width])
                held += len(parts[-1])
            if held > 1 << 23:
                yield rows()
                rids, ids, spans, weights, parts, held = [], [], [], [], [], 0
        yield rows()


def snippets(texts: DataFrame, width: int) -> DataFrame:
    """The bytes of each block of ``with_spans``: (rid, id, span, weight, text)."""
    return texts.mapInArrow(functools.partial(_snippets, width=width), "rid long, id long, span long, weight int, text binary")


def doubled(width: int) -> list[int]:
    """Lengths of growing ranks, each at most twice the one before, up to what all windows of a part share."""
    shared = width - PART + 1
    return [max(1, -(-shared // k)) for k in (4, 2, 1)]


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of the blocks in snippets, cut at multiples of PART units before the owner.

    The units that all windows of a part share begin at one position.  Its ranks of length h
    are pairs: the rank of half the length there, and that rank as far on as h needs.
    """
    lengths = doubled(width)
    for batch in batches:
        spans = batch.column(2).to_numpy()
        for a, b, data, offsets in slices(batch.column(4)):
            sums = prefix_sums(BYTE_CODE[data])
            start, size, place = _unpack(spans[a:b])
            low, high = (place - size + 1) // PART, place // PART  # parts are numbered by units before the owner
            count = high - low + 1
            row = np.repeat(np.arange(b - a), count)
            part = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            far, near = part * PART + PART - 1, part * PART
            first, last = place[row] - np.minimum(far, place[row]), place[row] - np.maximum(near, (place - size + 1)[row])
            at = offsets[row]
            begin = at + place[row] - near
            ranks = []
            for half, h in zip(lengths, lengths[1:]):
                # The rank of the pair (half at the position, half at the offset h - half).
                pair = mix(span_hash(sums, begin, begin + half) ^ _SALT) + span_hash(sums, begin + h - half, begin + h)
                ranks.append(pa.array(mix(pair + part.astype(np.int64).view(U)).view(np.int64)))
            outer = mix(span_hash(sums, at + first, at + last + width) ^ ((place[row] - first).astype(U) * _SALT))
            beside = [batch.column(k).slice(a, b - a).take(pa.array(row)) for k in (0, 1, 2, 3)]
            own = pa.array((start[row] + first) << START | (last - first) << COUNT | place[row] - first)
            yield pa.RecordBatch.from_arrays([*beside[:3], own, *ranks, pa.array(outer.view(np.int64)), beside[3]], ["rid", "id", "block_span", "span", "rank", "seed", "block", "n"])


def parts_of(found: DataFrame, width: int) -> DataFrame:
    """Parts of blocks from ``snippets``: (rid, id, block_span, span, rank, seed, block, n).

    rank and seed are ranks of growing length, block that of all units of the part.
    """
    return found.mapInArrow(functools.partial(_parts, width=width), "rid long, id long, block_span long, span long, rank long, seed long, block long, n int")


def repeated(found: DataFrame, rank: str = "seed") -> DataFrame:
    """Rows whose rank stands anywhere else too; those with a unique rank drop out."""
    ranks = found.where("n > 0").groupBy(rank).agg(F.sum("n").alias("n")).where("n > 1").select(rank)
    return found.where("n > 0").join(ranks, rank, "left_semi")


def apply_spans(base: DataFrame, spans: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Run ``function`` over batches (id, text, spans, carry): each text with its spans (all columns but rid and own), unmerged."""
    grouped = spans.groupBy("rid", "own").agg(F.collect_list(F.struct(*(c for c in spans.columns if c not in ("rid", "own")))).alias("spans"))
    return _with_texts(base, grouped, "left").select("id", "text", "spans", *(["carry"] if "carry" in base.columns else [])).mapInArrow(function, schema)


def covered(spans: pa.StructArray | None, n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        np.add.at(step, spans.field("start").to_numpy(), 1)
        np.add.at(step, spans.field("end").to_numpy(), -1)
    return np.cumsum(step[:-1]) > 0
