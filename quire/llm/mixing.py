"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate between 0 and ``most``.  Of all rates that bring each
source's tokens to its target, entropy balancing takes those with the least token-weighted
relative entropy to the corpus.  Further constraints couple the sources: each language's
share of all tokens, and the mean logarithm of documents' sizes, should stay what they are
in the corpus.  They are soft, as they needn't be feasible: a constraint's miss, as a share
of all tokens, costs its square divided by twice ``SOFT``.

The dual is ``sum_i w_i * g(x_i . u) - T . u + SOFT * N / 2 * |u_soft|**2`` for sizes w, features x
(the source, languages, length) and targets T, where g' = min(exp, most) caps rates inside
the dual.  Newton iterations minimise it: each is one aggregation on the cluster, of the
gradient and the Hessian's parts of every source, over the table of cells.  A cell stands
for all documents of one source, language and size, which have equal features.  The Hessian
is an arrow (sources meet only the coupling constraints), so one row a source is all that
reaches the driver, and steps take time in proportion to the number of sources.

Rates are then rounded into whole copies, in groups of about ``group`` documents of one
source: from large documents to small ones, each takes the copies that bring the group's
running total closest to its target.  Groups keep the hot source off any single task, and
rows that repeat a document are one entry with a count, however many there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, broadcast_if_small

#: Weight of the soft constraints' dual variables, as a share of all tokens.
SOFT = 0.03
#: Languages with a constraint of their own, the largest ones; the others share one.
LANGUAGES = 15


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word is cut down to its first character."""
    return F.coalesce(F.length(F.regexp_replace(text, r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "$1")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Targets of a table (source, source_size): weights by rank share the total, capped at ``most`` times the size.

    Sources rank by code point, null last, and weigh ``weights`` in turn.  The excess over a
    cap goes to the others by weight until none is above; the end of that is a water level
    L with target = min(cap, weight * L), found in the order of cap / weight.  The windows
    here run over one row a source, not over documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    caps = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # If this source and those after it aren't capped, they share what the ones before leave.
    levelled = caps.withColumn("level", (total - before) / rest)
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return levelled.withColumn("level", found["level"]).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


@dataclass
class Dual:
    """The dual variables: one a source (None where the rate is ``most`` or 0 throughout), and those of the soft constraints."""

    sources: dict[str | None, float]
    soft: np.ndarray
    steps: int
    miss: float


def _features(languages: list[tuple[str | None, float]], mean: float, deviation: float) -> list[Column]:
    """Soft features, each with token-weighted mean 0 in the corpus."""
    out = [F.col("language").eqNullSafe(F.lit(name)).cast("double") - F.lit(share) for name, share in languages]
    return [*out, (F.log("size") - F.lit(mean)) / F.lit(deviation)] if deviation > 1e-9 else out


def balance(cells: DataFrame, targets: dict[str | None, tuple[float, float]], features: list[Column], most: float, steps: int = 50, tolerance: float = 1e-10) -> Dual:
    """Newton's method on the dual over cells (source, language, size, n); ``targets`` has (size, target) of each source.

    A step is halved until the dual falls, so it converges from any start.
    """
    total, k = sum(size for size, _ in targets.values()), len(features)
    free = [s for s, (size, goal) in targets.items() if size > 0 and 0 < goal < most * size * (1 - 1e-12)]
    u, v = {s: math.log(targets[s][1] / targets[s][0]) for s in free}, np.zeros(k)
    rates = {s: 0.0 if size <= 0 or goal <= 0 else float(most) for s, (size, goal) in targets.items() if s not in u}
    fixed = sum(goal for s, (_, goal) in targets.items() if s not in u)
    spark, top = cells.sparkSession, math.log(most)

    def sums(u: dict, v: np.ndarray) -> dict:
        """Of each source: the dual's value, then sums over its cells of rate and slope times features."""
        own = spark.createDataFrame([(s, u[s]) for s in free], "s string, u double")
        x = F.col("u") + sum((F.lit(float(w)) * f for w, f in zip(v, features)), F.lit(0.0))
        w = (F.col("size") * F.col("n")).cast("double")
        capped = F.col("x") >= top
        rate, slope = w * F.least(F.lit(float(most)), F.exp("x")), w * F.when(capped, 0.0).otherwise(F.exp("x"))
        value = w * F.when(capped, most * (1 + F.col("x") - top)).otherwise(F.exp("x"))
        parts = [value, rate, slope, *(rate * f for f in features), *(slope * f for f in features), *(slope * features[i] * features[j] for i in range(k) for j in range(i + 1))]
        joined = cells.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s"))).withColumn("x", x)
        return {r["source"]: np.array(r[1:], float) for r in joined.groupBy("source").agg(*(F.sum(p).alias(f"p{i}") for i, p in enumerate(parts))).collect()}

    # Sources with a fixed rate add a constant to the soft gradient.
    constant = np.zeros(k)
    if k and rates:
        own = spark.createDataFrame(list(rates.items()), "s string, rate double")
        w = F.col("size") * F.col("n") * F.col("rate")
        row = cells.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s"))).agg(*(F.sum(w * f).alias(f"p{i}") for i, f in enumerate(features))).first()
        constant = np.array([x or 0.0 for x in row], float)

    def dual(found: dict, u: dict, v: np.ndarray) -> float:
        return sum(found[s][0] - targets[s][1] * u[s] for s in free) + float(constant @ v) + SOFT * total / 2 * float(v @ v)

    lower = np.tril_indices(k)
    miss, step, found = 0.0, 0, sums(u, v) if free else {}
    while free and step < steps:
        step += 1
        gradient = {s: found[s][1] - targets[s][1] for s in free}
        soft, hessian = constant + SOFT * total * v, np.eye(k) * SOFT * total
        for s in free:
            a, b = found[s][3 + k : 3 + 2 * k], np.zeros((k, k))
            b[lower] = found[s][3 + 2 * k :]
            slope = max(found[s][2], 1e-9 * targets[s][0])
            soft = soft + found[s][3 : 3 + k] - a * (gradient[s] / slope)
            hessian += b + np.tril(b, -1).T - np.outer(a, a) / slope
        miss = max(abs(g) / targets[s][1] for s, g in gradient.items())
        dv = -np.linalg.solve(hessian, soft) if k else np.zeros(0)
        du = {s: float(-(gradient[s] + found[s][3 + k : 3 + 2 * k] @ dv) / max(found[s][2], 1e-9 * targets[s][0])) for s in free}
        if miss < tolerance and np.abs(dv).max(initial=0) < 1e-7:
            break
        size, now = min(1.0, 8.0 / max(1e-9, *(abs(x) for x in du.values()))), dual(found, u, v)
        while True:
            then_u, then_v = {s: u[s] + size * du[s] for s in free}, v + size * dv
            then = sums(then_u, then_v)
            if size < 1e-6 or dual(then, then_u, then_v) <= now + 1e-9 * abs(now):
                break
            size /= 2
        u, v, found = then_u, then_v, then
    # Sums over a cluster differ in their last digits; rounding lets reruns agree.
    return Dual({s: round(u[s], 8) if s in u else None for s in targets}, np.round(v, 8), step, miss)


def _round_group(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of all repeats of each document of one group; ``rows`` are in order, the largest first."""
    copies, owed = np.zeros(len(rows), np.int64), 0.0
    for i, (size, n, rate) in enumerate(zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist())):
        owed += rate * size * n
        c = min(most * n, max(0, round(owed / size))) if size else 0
        owed -= c * size
        copies[i] = c
    return rows.assign(copies=copies)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", language_col: str | None = "lang", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, group: int = 8192) -> DataFrame:
    """One row a distinct document: id, key (hash of id and text), source, language, size, n (its rows), source_size, target, rate and copies (of all its rows)."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    language = F.col(language_col).cast("string") if language_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), language.alias("language"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("key"))
    sized = tables.keep(base.groupBy("id", "source", "language", "size", "key").agg(F.count("*").alias("n")), "sizes")
    cells = tables.keep(sized.groupBy("source", "language", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "cells")
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("rows").alias("rows"))
    sums = tables.keep(sums, "sources")
    goals = source_targets(sums.select("source", "source_size"), weights, most).collect()  # one row a source
    targets = {r["source"]: (float(r["source_size"]), r["target"]) for r in goals}
    total = sum(size for size, _ in targets.values())
    some = cells.where("size > 0")
    w = F.col("size") * F.col("n")
    languages = some.groupBy("language").agg(F.sum(w).alias("w")).orderBy(F.desc("w"), F.col("language").asc_nulls_last()).limit(LANGUAGES + 1).collect()
    languages = [(r["language"], r["w"] / total) for r in languages[:-1]]  # the last one follows from the others
    mean, square = some.agg(F.sum(w * F.log("size")), F.sum(w * F.log("size") * F.log("size"))).first()
    mean = (mean or 0.0) / max(total, 1.0)
    features = _features(languages, round(mean, 9), round(math.sqrt(max(0.0, (square or 0.0) / max(total, 1.0) - mean * mean)), 6))
    found = balance(some, targets, features, float(most))
    known = [(r["source"], r["source_size"], r["target"], found.sources[r["source"]]) for r in goals]
    rates = spark.createDataFrame(known, "s string, source_size long, target double, u double").join(sums.select(F.col("source").alias("s2"), F.ceil(F.col("rows") / group).alias("groups")), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    placed = sized.join(broadcast_if_small(rates, row_bytes=200), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tilt = F.exp(F.col("u") + sum((F.lit(float(v)) * f for v, f in zip(found.soft, features)), F.lit(0.0)))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("u").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), tilt))
    placed = placed.withColumn("rate", rate).withColumn("part", F.pmod("key", "groups")).drop("u", "groups")

    def rounded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _round_group(rows.sort_values(["size", "key", "language"], ascending=[False, True, True], kind="stable"), most)

    return placed.groupBy("source", "part").applyInPandas(rounded, placed.withColumn("copies", F.lit(0).cast("long")).schema).drop("part")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", language_col: str | None = "lang", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, group: int = 8192) -> DataFrame:
    """One row a document: id, size, source_size, target, rate, copies and taken = copies * size.

    Size is the number of words, 0 for a null text.  See ``source_targets`` for targets and
    the module for rates and copies; no document has more than ``most`` copies.  Documents
    without words have no copies.  A null source is a source, a null language a language;
    ``language_col`` may be None or missing.  Repeated rows and rows with a null id are
    documents of their own; of equal rows, some may have one copy more than others.  Ties go
    by a hash of id and text, so reruns agree on the whole table.  Other columns are ignored;
    an empty table gives an empty result.
    """
    mixed = mix_documents(docs, id_col, text_col, source_col, language_col, weights, most, group)
    each = F.floor(F.col("copies") / F.col("n"))
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    out = mixed.select("id", "size", "source_size", "target", "rate", each.alias("each"), (F.col("copies") - each * F.col("n")).alias("more"), repeat.alias("k"))
    out = out.withColumn("copies", F.col("each") + (F.col("k") <= F.col("more")).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
