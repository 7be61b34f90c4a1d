"""Places of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order column that a stretch spans, and of stretches that are scanned together.
STRETCH_BITS, SCAN_BITS = 16, 24
#: Values of the order column that one task sorts together for a group.
STRETCH = 1 << STRETCH_BITS


def in_list_order(rows: DataFrame) -> DataFrame:
    """Adds ``seq``, the place of each row in its list as it is read: of rows that share their ``ord``, the first of the list goes first."""
    return rows.withColumn("seq", F.monotonically_increasing_id())


def ties(rows: DataFrame) -> tuple[str, ...]:
    """What orders rows of one ``ord``, if they have it."""
    return ("seq",) if "seq" in rows.columns else ()


def numbered(rows: DataFrame, keys: list[str], name: str = "rank", order: str = "ord", then: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place, from 1, of each row in its group by an integer column, and where that is equal by ``then``.

    Rows are sorted in stretches of ``order`` and the places of a stretch start behind the
    rows of those before, so a group that holds much of the table isn't one task's.
    """
    at = F.floor(F.col(order) / STRETCH)
    placed = rows.withColumn("_g", F.struct(F.struct(*keys).alias("k"), at.alias("at")))  # structs are equal where their nulls are
    within = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_g").orderBy(order, *then)))
    counts = placed.groupBy("_g").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g.k").orderBy("_g.at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("_g").alias("_s"), F.coalesce(before, F.lit(0)).alias("_start"))
    return within.join(starts, F.col("_g") == F.col("_s")).select(*rows.columns, (F.col("_place") + F.col("_start")).alias(name))


def _before(ends: DataFrame, bits: int) -> DataFrame:
    """(_g, _before) from (_g struct<k, at>, _value): the last value of the places of k before ``at``, which has ``bits`` bits."""
    at = F.col("_g.at")
    window = lambda group: F.last("_value", ignorenulls=True).over(Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    if bits <= SCAN_BITS:
        return ends.select("_g", window(F.col("_g.k")).alias("_before"))
    wide = ends.withColumn("_w", F.struct(F.col("_g.k").alias("k"), F.shiftright(at, SCAN_BITS).alias("at")))
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), at))
    upper = _before(wide.groupBy(F.col("_w").alias("_g")).agg(last.alias("_value")), bits - SCAN_BITS)
    inside = wide.withColumn("_inside", window(F.col("_w")))
    return inside.join(upper.select(F.col("_g").alias("_u"), F.col("_before").alias("_upper")), F.col("_w") == F.col("_u")).select("_g", F.coalesce("_inside", "_upper").alias("_before"))


def carried(rows: DataFrame, keys: list[str], value: str, name: str, order: str = "ord") -> DataFrame:
    """Adds the last non-null ``value`` at or before each row of its group, by an integer column; null before the first.

    Each stretch of ``order`` is scanned by itself, and its last value is carried over to the
    next ones by the same scan over stretches.  So one group, as long as it may be, spreads over
    tasks: none sorts more of it than STRETCH values of ``order``, or 2**SCAN_BITS stretches.  Null keys are
    a group.
    """
    at = F.shiftright(F.col(order).cast("long"), STRETCH_BITS)
    placed = rows.withColumn("_g", F.struct(F.struct(F.lit(0), *keys).alias("k"), at.alias("at")))  # structs are equal where their nulls are
    ends = placed.groupBy("_g").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_value"))
    starts = _before(ends, 63 - STRETCH_BITS).withColumnRenamed("_g", "_s")
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_inside", inside).join(starts, F.col("_g") == F.col("_s")).select(*rows.columns, F.coalesce("_inside", "_before").alias(name))
