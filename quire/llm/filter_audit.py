"""Audit of how filters interact: every order of the filters, by adjacent transpositions.

A document is only the set of filters it fails, its mask, so all orders can be judged from
the counts of masks, at most 32 cells a part for five filters.  The walk visits the orders
so that each differs from the one before by a swap of two neighbours.  A swap leaves what
the filters before it remove and what those behind it see, so only its two steps are
counted anew.  Shapley sums accumulate along the walk: a filter's removals count for all
orders since they last changed.

Masks are computed from whole texts with built-in functions, and cells are sums that are
aggregated before each shuffle; only the cells of one part reach the Python function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters in the order of their bits.
FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone (E, the repeat, needs the table)."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures(F.col("text")).items()), F.lit(0))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    own = own.select("id", "part", F.sha2("text", 256).alias("key"), mask.alias("mask"))
    own = own.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n"))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = own.join(told, F.col("id") == F.col("label_id"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    # Copies of a text: all but the rows of its smallest id, and but those without id, repeat it.
    copies = rows.groupBy("key", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    )
    kind = F.struct("part", "is_good", "is_toxic", "n", "without", "first")
    texts = copies.groupBy("key", "mask").agg(F.collect_list(kind).alias("kinds"), F.min("first.id").alias("least"))
    each = texts.select("mask", "least", F.explode("kinds").alias("k")).select("mask", "least", "k.*")
    unique = F.col("without") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), unique.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - unique).alias("n")))
    told = each.select("part", "is_good", "is_toxic", F.explode(split).alias("c"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0))
    return told.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def transpositions(n: int) -> Iterator[int]:
    """Places i whose swap with i + 1, one after the other, leads through all orders of n items."""
    place, step = list(range(n)), [-1] * n  # of each item, and where it moves next
    at = list(range(n))
    while True:
        for item in reversed(range(n)):
            there = place[item] + step[item]
            if 0 <= there < n and at[there] < item:
                break
        else:
            return
        other, here = at[there], place[item]
        at[here], at[there], place[item], place[other] = other, item, there, here
        yield min(here, there)
        for larger in range(item + 1, n):
            step[larger] = -step[larger]


def walk(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> tuple[dict[str, list[tuple[int, int, int, int]]], list[int]]:
    """By order: (kept, removed, good_lost, toxic_lost) of each step; and each filter's removals summed over all orders.

    ``counts`` has (documents, good, toxic) by mask.
    """
    n = len(filters)
    masks = list(counts.items())

    def removed_by(item: int, before: int) -> tuple[int, int, int]:
        """What one filter removes of the documents that pass those in ``before``."""
        found = [c for mask, c in masks if mask >> item & 1 and not mask & before]
        return sum(c[0] for c in found), sum(c[1] for c in found), sum(c[2] for c in found)

    order, steps, before, left = list(range(n)), [], 0, sum(c[0] for _, c in masks)
    for item in order:
        gone = removed_by(item, before)
        left -= gone[0]
        steps.append((left, *gone))
        before |= 1 << item
    total, since, visit, out = [0] * n, [0] * n, 0, {}
    moves = transpositions(n)
    while True:
        out["".join(filters[i] for i in order)] = list(steps)
        visit += 1
        i = next(moves, None)
        if i is None:
            break
        for k in (i, i + 1):  # their removals have stood since they last changed
            total[order[k]] += steps[k][1] * (visit - since[order[k]])
            since[order[k]] = visit
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << item for item in order[:i])
        first, second = removed_by(order[i], before), removed_by(order[i + 1], before | 1 << order[i])
        entering = steps[i - 1][0] if i else steps[0][0] + steps[0][1]
        steps[i], steps[i + 1] = (entering - first[0], *first), (entering - first[0] - second[0], *second)
    for k, item in enumerate(order):
        total[item] += steps[k][1] * (visit - since[item])
    return out, total


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for batch in batches:
        for part, own in zip(batch["part"], batch["cells"]):
            counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in own}
            orders, shapley = walk(counts)
            fails = [sum(c[0] for mask, c in counts.items() if mask >> i & 1) for i in range(len(FILTERS))]
            alone = [counts.get(1 << i, (0, 0, 0))[0] for i in range(len(FILTERS))]
            rows = []
            for order, steps in orders.items():
                for k, (kept, removed, good, toxic) in enumerate(steps):
                    i = FILTERS.index(order[k])
                    rows.append((part, order, k + 1, kept, removed, fails[i] - removed, alone[i], good, toxic, shapley[i]))
            yield pd.DataFrame(rows, columns=names)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters fail a document with: A under 100 words; B less than 80% distinct words; C more
    than 10% of A-Z; D any of ``#$%&*|``; E the text of a smaller id anywhere in the table.

    A null text counts as empty, a null part as "".  A row without id never fails E, nor
    makes another fail it; rows that repeat id and text count each, and don't make each
    other fail.  A document is good or toxic if any of its labels says so; labels of null
    ids, and columns that clash, are ignored.  A table without rows gives none.
    """
    own = cells(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return own.mapInPandas(_rows, schema)
