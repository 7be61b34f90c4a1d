"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Each text becomes its set of word shingles.  Texts with equal sets form a class, which
   its smallest id represents; only representatives go on.
2. One-permutation hashing with optimal densification gives the signature, whose bands
   name buckets.  Every member of a bucket makes one edge to the bucket's smallest id, so
   candidate edges are at most as many as bucket rows.  Edges are confirmed on full sets.
3. A star misses links between members that its hub isn't similar to.  So buckets whose
   members are still in several components are compared once more across components, in
   blocks of bounded size.  A block's task compares full sets and returns, for each
   member and other component, one pair that links them at most.

Two texts at the threshold share no band with probability (1 - 0.75**6)**64 = 4e-6.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import slices
from .shared import Tables, broadcast_if_small, components, runs
from .sketches import band_keys, one_permutation, set_digests, shingle_sets

#: Items whose columns are held in memory at once when two blocks are compared.
COLUMNS = 16_384


def _profiles(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            hashes, at = shingle_sets(data, offsets, shingle)
            one, two = set_digests(hashes, at)
            size = np.diff(at)
            for lo in range(a, b, 1024):
                hi = min(b, lo + 1024)
                own = np.flatnonzero(size[lo - a : hi - a])
                part, begin = at[lo - a : hi - a + 1], at[lo - a]
                signature = one_permutation(hashes[begin : part[-1]], np.append(part[:-1][own], part[-1]) - begin, bands * rows)
                keys = band_keys(signature, rows)
                n = np.zeros(hi - lo + 1, np.int32)
                n[1:][own] = 1
                n = np.cumsum(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(size[lo - a : hi - a], pa.int64()),
                        pa.array(one[lo - a : hi - a].view(np.int64)),
                        pa.array(two[lo - a : hi - a].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(n * np.int32(bands)), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["id", "n_shingles", "d1", "d2", "bands"],
                )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            hashes, at = shingle_sets(data, offsets, shingle)
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["id", "items"])


def _shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``one`` with every set of ``two``."""
    items = np.intersect1d(np.concatenate(one), np.concatenate(two))
    total = np.zeros((len(one), len(two)), np.int64)
    for at in range(0, len(items), COLUMNS):
        part, sides = items[at : at + COLUMNS], []
        for sets in (one, two):
            flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            place = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[place] == flat
            sides.append(np.zeros((len(sets), len(part)), np.float32))
            sides[-1][row[hit], place[hit]] = 1
        total += (sides[0] @ sides[1].T).astype(np.int64)  # at most COLUMNS each, exact in single precision
    return total


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Similar pairs of different components from runs that each hold one pair of blocks.

    Each member gets one partner of each other component at most; pairs are exact on full sets.
    """
    for run in runs(batches, ["key", "left", "right"]):
        ids, comp, side = (run[c].to_numpy() for c in ("id", "comp", "side"))
        items = [x.values.to_numpy() for x in run["items"]]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        size = np.array([len(x) for x in items])
        shared = _shared_counts([items[i] for i in one], [items[i] for i in two])
        near = (100 * shared >= percent * (size[one][:, None] + size[two] - shared)) & (comp[one][:, None] != comp[two])
        i, j = np.nonzero(near)
        if len(i):
            _, first = np.unique(np.stack([i, comp[two][j]]), axis=1, return_index=True)
            a, b = ids[one[i[first]]], ids[two[j[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _block_rows(crowd: DataFrame, block: int) -> DataFrame:
    """Rows of ``crowd`` (key, id, comp) once for each pair of blocks they take part in.

    A component with ``block`` or more members in a bucket gets blocks of its own, the
    others share some; pairs of blocks of one such component are left out.
    """
    sizes = crowd.groupBy("key", "comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < block).groupBy("key").agg(F.sum("n").alias("m"))
    sizes = sizes.join(small, "key", "left").select("key", "comp", F.when(F.col("n") >= block, F.col("comp")).alias("own"), F.ceil(F.when(F.col("n") >= block, F.col("n")).otherwise(F.col("m")) / block).alias("parts"))
    placed = crowd.join(sizes, ["key", "comp"]).withColumn("block", F.concat_ws("-", "own", F.pmod(F.xxhash64("id"), "parts")))
    blocks = sizes.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("key", "own", F.concat_ws("-", "own", "part").alias("block")).distinct()
    other = blocks.select("key", F.col("own").alias("own2"), F.col("block").alias("right"))
    pairs = blocks.join(other, "key").where("block < right or (block = right and own is null)").where("own is null or own2 is null or own <> own2").select("key", F.col("block").alias("left"), "right")
    sides = pairs.select("key", "left", "right", F.explode(F.when(F.col("left") == F.col("right"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")))
    return placed.join(sides, ["key", "block"]).select("key", "left", "right", "side", "id", "comp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = 64, rows: int = 6, block: int = 256
) -> DataFrame:
    """One row a document: id, n_shingles, component_id and kept.

    Documents are linked when ``100 * |intersection| >= percent * |union|`` of their sets
    of ``shingle`` lower-cased (A-Z) words; component_id is the smallest id reachable by
    links and kept tells whether that is the document's own.

    Null, empty and wordless texts have an empty set and are linked with nothing, as are
    rows with a null id (their component_id is null and kept is true).  Each repeated row
    gets the result of its id, which is linked through any of its texts.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = tables.keep(
        base.mapInArrow(functools.partial(_profiles, shingle=shingle, bands=bands, rows=rows), "id long, n_shingles long, d1 long, d2 long, bands array<long>"), "profiles"
    )
    some = profile.where("n_shingles > 0 and id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    reps = some.join(classes.withColumnRenamed("rep", "id"), ["d1", "d2", "id"]).select("id", "bands").dropDuplicates(["id", "bands"])
    members = reps.select("id", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = tables.keep(members.join(hubs, "key"), "crowded")
    needed = broadcast_if_small(crowded.select("id").distinct())
    sets = tables.keep(base.join(needed, "id", "left_semi").mapInArrow(functools.partial(_sets, shingle=shingle), "id long, items array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("u"))
        return both.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b").distinct()

    stars = tables.keep(confirmed(crowded.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()), "stars")
    first = tables.keep(components(stars, tables), "components")
    placed = crowded.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    crowd = tables.keep(placed.join(mixed, "key", "left_semi"), "crowd")
    blocks = _block_rows(crowd, block).join(sets, "id").repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    compared = blocks.select("key", "left", "right", "side", "id", "comp", "items").mapInArrow(functools.partial(_alike, percent=percent), "a long, b long").distinct()
    late = tables.keep(compared, "late")  # exact as they are: tasks compare whole sets
    parts = tables.keep(components(stars.union(late), tables), "components")

    placed = some.select("id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = profile.select("id", "n_shingles").join(placed, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
