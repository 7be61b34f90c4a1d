"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so links are pairs within epsilon.  The
vectors are projected on their leading principal dimensions and on the norm of what is left,
which never lengthens a distance, sorted by the grid cells of side epsilon of the first of
these, and cut into intervals of the sorted sequence.  Pairs of intervals are joined by
recursion: a pair whose bounding boxes are more than epsilon apart is skipped, others are
halved down to small blocks, which are compared by cosines of the full vectors in double
precision.  The upper part of the recursion starts at each interval, in tasks that hold the
intervals' boxes, and the lower part works inside tasks, one for each pair left.

Every vector goes to as many tasks as its interval has pairs, so intervals are as large as
a task can hold (``INTERVAL_BYTES``), or smaller where a small table would keep few cores
busy.  Where grid cells don't separate the data, all pairs are left.

Equal vectors are one class with one representative.  A pair of intervals gives a count of
links for each vector and the edges of a spanning forest, never its pairs, so a dense
cluster costs comparisons but no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, broadcast_if_small, components, runs

#: Leading dimensions of the grid and of the boxes, and leading coordinates that the principal dimensions are taken of.
GRID_DIMS, BOX_DIMS, PCA_DIMS = 8, 16, 512
#: Bytes of the vectors of an interval, and vectors of a block that is compared at once.
INTERVAL_BYTES, BLOCK = 16 << 20, 256
#: What rounding may add to a distance between projections.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dims + 1, dims + 1))
    for batch in batches:
        if batch.num_rows:
            x = np.hstack([_matrix(batch.column(0))[:, :dims], np.ones((batch.num_rows, 1))])
            total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])


def principal_dimensions(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading principal dimensions, as columns; one aggregate of bounded size reaches the driver."""
    dims = min(dim, PCA_DIMS)
    sums = vectors.select("vector").mapInArrow(functools.partial(_moments, dims=dims), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    m = np.zeros((dims + 1) ** 2)
    m[sums["at"].to_numpy()] = sums["value"].to_numpy()
    m = m.reshape(dims + 1, dims + 1)
    n, mean = max(m[-1, -1], 1.0), m[-1, :-1] / max(m[-1, -1], 1.0)
    _, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :BOX_DIMS]


def _cells(batches: Iterator[pa.RecordBatch], axes: np.ndarray, epsilon: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cell = np.floor(_matrix(batch.column(2))[:, : len(axes)] @ axes[:, :GRID_DIMS] / epsilon).astype(np.int32)
            cells = pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel()), cell.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["id", "n", "vector", "cells"])


def _numbered(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number the vectors of a sorted partition and project them."""
    from pyspark import TaskContext

    done, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        if batch.num_rows:
            at = np.arange(done, done + batch.num_rows)
            done += batch.num_rows
            lead = _matrix(batch.column(2))[:, : len(axes)] @ axes
            lead = np.hstack([lead, np.sqrt(np.maximum(0, 1 - (lead * lead).sum(1, keepdims=True)))])
            lead = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), lead.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(at), *batch.columns[:3], lead], ["part", "at", "id", "n", "vector", "lead"])


def _in_sequence(numbered: DataFrame, interval: int | None, dim: int) -> DataFrame:
    """Places in the whole sequence, and its intervals, from places in partitions; one row a partition reaches the driver."""
    parts = numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *(r["n"] for r in parts)]).tolist()
    spark = numbered.sparkSession
    if interval is None:
        wanted = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
        interval = max(1, min(INTERVAL_BYTES // (8 * dim), max(BLOCK, -(-starts[-1] // wanted))))
    offsets = spark.createDataFrame([(r["part"], s) for r, s in zip(parts, starts)], "part long, start long")
    placed = numbered.join(F.broadcast(offsets), "part").withColumn("at", F.col("at") + F.col("start"))
    return placed.withColumn("interval", F.floor(F.col("at") / interval)).drop("part", "start")


def recursive_pairs(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, epsilon: float, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of boxes that may hold vectors within epsilon; with ``same``, of one sequence and i <= j."""
    stack = [(0, len(low), 0, len(low2))] if len(low) and len(low2) else []
    while stack:
        a, b, c, d = stack.pop()
        if same and a >= d:
            continue
        gap = np.maximum(0, np.maximum(low[a:b].min(0) - high2[c:d].max(0), low2[c:d].min(0) - high[a:b].max(0)))
        if (gap * gap).sum() > epsilon * epsilon:
            continue
        if b - a == 1 and d - c == 1:
            if not same or a <= c:
                yield a, c
            continue
        left = [(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)]
        right = [(c, d)] if d - c == 1 else [(c, (c + d) // 2), ((c + d) // 2, d)]
        stack.extend((*x, *y) for x in left for y in right)


def _boxes(lead: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(0, len(lead), block)
    return np.minimum.reduceat(lead, cuts), np.maximum.reduceat(lead, cuts)


def _joined(batches: Iterator[pa.RecordBatch], cosine: float, epsilon: float, block: int) -> Iterator[pa.RecordBatch]:
    """Links of the pairs of intervals in the runs: (a, b, links), an edge, or a count for a with null b."""
    for run in runs(batches, ["pair"]):
        run = run.combine_chunks()
        side, ids, weight = run["side"].to_numpy(), run["id"].to_numpy(), run["n"].to_numpy().astype(np.float64)
        x, lead = _matrix(run["vector"].combine_chunks()), run["lead"].combine_chunks()
        lead = lead.flatten().to_numpy().reshape(len(ids), -1)
        n, label, links = int((side == 0).sum()), np.arange(len(ids)), np.zeros(len(ids))
        same = n == len(ids)
        first = _boxes(lead[:n], block)
        second, base = (first, 0) if same else (_boxes(lead[n:], block), n)
        for i, j in recursive_pairs(*first, *second, epsilon, same):
            p, q = slice(i * block, min(n, (i + 1) * block)), slice(base + j * block, min(len(ids), base + (j + 1) * block))
            near = x[p] @ x[q].T >= cosine
            if same and i == j:
                near &= ~np.eye(len(near), dtype=bool)
            if not near.any():
                continue
            links[p] += near @ weight[q]
            if not (same and i == j):
                links[q] += weight[p] @ near
            r, c = np.nonzero(near)
            r, c = r + p.start, c + q.start
            while True:  # least labels along the links
                m = np.minimum(label[r], label[c])
                if (m == label[r]).all() and (m == label[c]).all():
                    break
                np.minimum.at(label, label[r], m)
                np.minimum.at(label, label[c], m)
                while (label != label[label]).any():
                    label = label[label]
        edge, count = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
        a, b = np.concatenate([ids[edge], ids[count]]), np.concatenate([ids[label[edge]], np.zeros(len(count), ids.dtype)])
        number = np.concatenate([np.zeros(len(edge), np.int64), links[count].astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) >= len(edge)), pa.array(number)], ["a", "b", "links"])


def _pairs(batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray, epsilon: float) -> Iterator[pa.RecordBatch]:
    """For each interval its pairs with itself and later ones: (pair, interval, side), a row for each side."""
    n = len(low)
    for batch in batches:
        for i in batch.column(0).to_pylist():
            j = np.array([i + d for _, d in recursive_pairs(low[i : i + 1], high[i : i + 1], low[i:], high[i:], epsilon, False)], np.int64)
            other = j[j != i]
            pair, interval = np.concatenate([i * n + j, i * n + other]), np.concatenate([np.full(len(j), i), other])
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(interval), pa.array((np.arange(len(pair)) >= len(j)).astype(np.int32))], ["pair", "interval", "side"])


def interval_pairs(ordered: DataFrame, dims: int, epsilon: float, tables: Tables) -> DataFrame:
    """(pair, interval, side) of the pairs of intervals that boxes don't keep apart; one box an interval reaches the driver."""
    edges = [f(F.col("lead")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(dims)]
    boxes = ordered.groupBy("interval").agg(*edges).orderBy("interval").toPandas()
    low, high = (boxes[[f"{f}{k}" for k in range(dims)]].to_numpy() for f in ("min", "max"))
    each = ordered.sparkSession.range(0, len(boxes), 1, max(1, min(len(boxes), 2000)))
    return tables.keep(each.mapInArrow(functools.partial(_pairs, low=low, high=high, epsilon=epsilon), "pair long, interval long, side int"), "pairs")


def _links(vectors: DataFrame, dim: int, cosine: float, tables: Tables, interval: int | None, block: int) -> DataFrame:
    """Rows of ``_joined`` for the vectors (id, n, vector) of one length."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    axes = principal_dimensions(vectors, dim)
    cells = tables.keep(vectors.mapInArrow(functools.partial(_cells, axes=axes, epsilon=epsilon), "id long, n long, vector array<double>, cells array<int>"), "cells")
    ordered = cells.repartitionByRange("cells", "id").sortWithinPartitions("cells", "id")
    ordered = tables.keep(ordered.mapInArrow(functools.partial(_numbered, axes=axes), "part long, at long, id long, n long, vector array<double>, lead array<double>"), "ordered")
    tables.drop(cells)
    ordered = _in_sequence(ordered, interval, dim)
    sides = interval_pairs(ordered, axes.shape[1] + 1, epsilon, tables)
    placed = ordered.join(broadcast_if_small(sides), "interval")
    placed = placed.repartition(max(1, min(sides.where("side = 0").count(), 20_000)), "pair").sortWithinPartitions("pair", "side", "at")
    placed = placed.select("pair", "side", "id", "n", "vector", "lead")
    return placed.mapInArrow(functools.partial(_joined, cosine=cosine, epsilon=epsilon, block=block), "a long, b long, links long")


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, interval: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row a vector: id, n_links, component_id and kept.

    Vectors of equal length with cosine >= ``cosine`` (0 to 1, in double precision) are
    linked.  n_links counts the other rows that a row is linked with directly, component_id
    is the smallest id that links reach and kept tells whether that is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; neither do rows with a null id (component_id null, kept true).  Repeated rows
    are linked with each other.  Other columns are ignored; an empty table gives an empty
    result.  ``interval`` and ``block`` are numbers of vectors, which change the work only.
    """
    tables = Tables(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), (usable & F.col(id_col).isNotNull()).alias("usable"))
    base = base.withColumn("content", F.when(F.col("usable"), F.md5(F.array_join(F.col("vector").cast("array<string>"), ","))))
    some = base.where("usable")
    classes = tables.keep(some.groupBy("content").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    found = None
    for (dim,) in classes.select(F.size("vector")).distinct().collect():
        part = _links(classes.where(F.size("vector") == dim).select("id", "n", "vector"), dim, cosine, tables, interval, block)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    found = tables.keep(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b"), tables)
    reps = classes.select("content", F.col("id").alias("rep"), "n").join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select("content", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "content").join(reps, "content", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
