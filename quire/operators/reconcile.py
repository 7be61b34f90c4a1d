"""Reconcile of corrected print with the data: what the printed entries say and the resolved works don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DOUBLE_QUOTES, SINGLE_QUOTES, Layout, Reconcile
from ..functions import text as T
from ..functions.unicode import normalised
from .export import field_texts
from .ordering import ties
from .tags import recoverable


def display_fields(rows: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(cat_no, ord, section and the recoverable fields): what rendering shows of collected rows; "" where there is nothing."""
    honorifics = F.lower("honorifics") if layout.honorifics_lowercase else F.col("honorifics")
    texts = field_texts(layout) | {"honorifics": F.coalesce(honorifics, F.lit(""))}
    own = [texts[f].alias(f) for f in recoverable(layout) if f != "work_number"]
    return rows.where("number is not null").select(F.col("number").alias("cat_no"), "ord", "section", *own, *ties(rows))


def folded(c: Column, policy: Reconcile) -> Column:
    """A text for comparison: straight quotes, no line ends, single spaces (it is in NFC already)."""
    if policy.fold_quotes:
        c = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return T.strip(F.regexp_replace(F.translate(c, "\r\n", ""), r"(?U)\s+", " "))


def _last(rows: DataFrame, side: str) -> DataFrame:
    """The last row of each number, as a struct; of rows that share the last ``ord``, the first by ``seq`` if they have it."""
    others = [c for c in rows.columns if c not in ("cat_no", "ord", "seq")]
    return rows.groupBy("cat_no").agg(F.max_by(F.struct(*others, "ord"), F.struct("ord", *(-F.col(c) for c in ties(rows)))).alias(side))


def aligned_sections(matched: DataFrame) -> DataFrame:
    """(section, aligned) from (section, other, ord): the other section with most numbers; ties go to the first in order, then by name."""
    both = matched.groupBy("section", "other").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return both.groupBy("section").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "other")).alias("m")).select("section", F.col("m.other").alias("aligned"))


def reconcile(printed: DataFrame, data: DataFrame, layout: Layout = Layout(), policy: Reconcile = Reconcile()) -> DataFrame:
    """Findings: kind, cat_no, field, db_value, low_value, section, severity and fix_channel.

    ``printed`` are parsed entries, ``data`` rows of ``display_fields``; both have cat_no, ord,
    section and the fields, and the last row of a number counts.  Differences that vanish in
    comparison are cosmetic: with ``suppress_cosmetic`` they have that severity, so that they
    can be looked at and left out.
    """
    fields = [f for f in recoverable(layout) if f != "work_number" and f in data.columns]
    nfc = {f"_{f}": normalised(F.col(f), "NFC") for f in fields}
    data = data.withColumns(nfc)
    both = _last(data, "d").join(_last(printed, "p"), "cat_no", "full")
    aligned = aligned_sections(both.where("d is not null and p is not null").select(F.col("d.section").alias("section"), F.col("p.section").alias("other"), F.col("p.ord").alias("ord")))
    small = aligned.select(F.col("section").alias("_s"), "aligned")  # one row a section
    rows = both.join(small, F.col("d.section") == F.col("_s"), "left")
    none = F.lit(None).cast("string")

    def candidate(kind: str, field: Column, old: Column, new: Column, section: Column, plain: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), field.alias("field"), old.alias("db_value"), new.alias("low_value"), section.alias("section"), plain.alias("plain"))

    text = lambda side, f: F.coalesce(F.col(side)[f], F.lit(""))
    matched, found = F.col("d").isNotNull() & F.col("p").isNotNull(), []
    for f in fields:
        found.append(F.when(matched & (text("d", f) != text("p", f)), candidate("field_change", F.lit(f), text("d", f), text("p", f), F.col("d.section"), text("d", f"_{f}"))))
    moved = matched & F.col("aligned").isNotNull() & (F.col("p.section") != F.col("aligned"))
    found.append(F.when(moved, candidate("room_move", none, F.col("d.section"), F.col("p.section"), F.col("p.section"))))
    found.append(F.when(F.col("d").isNull(), candidate("entry_added", none, none, text("p", "title"), F.col("p.section"))))
    found.append(F.when(F.col("p").isNull(), candidate("entry_removed", none, text("d", "title"), none, F.col("d.section"))))
    out = rows.select("cat_no", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("cat_no", "f.*")
    changed = F.when(folded(F.col("plain"), policy) == folded(F.col("low_value"), policy), "cosmetic")
    for f, severity in policy.field_severity.items():
        changed = changed.when(F.col("field") == f, severity)
    ranks = F.when(F.col("kind") == "field_change", changed.otherwise(policy.severity["field_change"]))
    channels = F.lit("review")
    for kind, channel in policy.channel.items():
        channels = F.when(F.col("kind") == kind, channel).otherwise(channels)
        ranks = ranks.when(F.col("kind") == kind, policy.severity.get(kind, "medium")) if kind != "field_change" else ranks
    out = out.withColumns({"severity": ranks.otherwise("medium"), "fix_channel": channels}).drop("plain")
    renamed = aligned.where(folded(normalised(F.col("section"), "NFC"), policy) != folded(F.col("aligned"), policy))
    kind = "section_rename"
    renamed = renamed.select(F.lit(kind).alias("kind"), none.alias("cat_no"), none.alias("field"), F.col("section").alias("db_value"), F.col("aligned").alias("low_value"), F.col("aligned").alias("section"), F.lit(policy.severity.get(kind, "medium")).alias("severity"), F.lit(policy.channel.get(kind, "review")).alias("fix_channel"))
    return out.unionByName(renamed).select("kind", "cat_no", "field", "db_value", "low_value", "section", "severity", "fix_channel")


def in_catalogue_order(findings: DataFrame) -> DataFrame:
    """Numeric catalogue numbers by value, then the others by text, then what has none."""
    number = T.whole_number(F.col("cat_no"))
    return findings.orderBy(F.col("cat_no").isNull(), number.isNull(), number, "cat_no", "kind", "field")


def finding_counts(findings: DataFrame) -> DataFrame:
    """(severity, fix_channel, n)."""
    return findings.groupBy("severity", "fix_channel").agg(F.count("*").alias("n"))


def coverage(printed: DataFrame, data: DataFrame) -> DataFrame:
    """One row: entries printed and in the data, and whether less than half was parsed."""
    sides = printed.select(F.lit(1).alias("p"), F.lit(0).alias("d")).unionAll(data.select(F.lit(0), F.lit(1)))
    both = sides.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("printed"), F.coalesce(F.sum("d"), F.lit(0)).alias("in_data"))
    return both.withColumn("suspicious", (F.col("in_data") > 0) & (2 * F.col("printed") < F.col("in_data")))


def with_works(findings: DataFrame, works: DataFrame) -> DataFrame:
    """Findings beside the first work of their number, if there is one."""
    first = works.where("cat_no is not null").groupBy("cat_no").agg(F.min_by("work_id", "ord").alias("work_id"))
    return findings.join(first, "cat_no", "left")
