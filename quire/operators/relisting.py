"""A re-import as one table: the works after it with their overrides and warnings, and the works before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Catalogue
from ..functions import text as T
from .match import match_plan
from .ordering import numbered
from .works import found_warnings, normalise_works

RAW = ("cat_no", "raw_title", "raw_artist", "raw_price", "raw_edition", "raw_artwork", "raw_medium")
OVERRIDES = {
    "title": "string", "title_cased": "string", "artist_name": "string", "artist_honorifics": "string", "price_numeric": "decimal(12,2)", "price_text": "string",
    "edition_total": "int", "edition_price": "decimal(12,2)", "artwork": "int", "medium": "string",
}
_OVERRIDE = ", ".join(f"{f}_override: {t}" for f, t in OVERRIDES.items())
_SOURCE = ", ".join(f"{c}: string" for c in RAW)
#: Columns of ``relisted_rows``.
SCHEMA = (
    "kind string, ord long, gallery string, section_position int, position long, work_id string, from_work string, origin string, outcome string, include_in_export boolean, "
    f"source struct<{_SOURCE}>, override struct<{_OVERRIDE}>, warnings array<struct<type: string, message: string>>"
)
#: Bits of ``ord`` below the section's position.
SECTION_BITS = 40
_PAIRED = ("cat_no", "fingerprint")


def _columns(available: Sequence[str], wanted: dict[str, str]) -> Column:
    """A struct of the wanted columns, null where there is none."""
    return F.struct(*((F.col(c) if c in available else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()))


def override_struct(overrides: DataFrame) -> Column:
    return _columns(overrides.columns, {f"{f}_override": t for f, t in OVERRIDES.items()})


def _side(works: DataFrame, old: bool) -> DataFrame:
    """(old, ord, gallery, include_in_export, work_id, source) of a list."""
    name = F.coalesce(T.blank_to_null(F.col("gallery")), F.lit("Uncategorised")).alias("gallery")
    return works.select(F.lit(old).alias("old"), F.col("ord").cast("long").alias("ord"), name, "include_in_export", (F.col("work_id") if old else F.lit(None)).cast("string").alias("work_id"), _columns(works.columns, dict.fromkeys(RAW, "string")).alias("source"))


def _sections(rows: DataFrame, whole: bool) -> DataFrame:
    """(gallery, old_section, new_section): one row a section, in the order the lists have them.

    A whole re-import starts its positions anew.  Otherwise known sections keep theirs and new ones follow behind the last.
    """
    first = rows.groupBy("gallery").agg(F.min(F.when(F.col("old"), F.col("ord"))).alias("o"), F.min(F.when(~F.col("old"), F.col("ord"))).alias("n"))
    place = lambda flag, order: F.row_number().over(Window.partitionBy(F.col(flag).isNull()).orderBy(order))
    known = first.withColumn("old_section", F.when(F.col("o").isNotNull(), place("o", "o")))
    if whole:
        return known.select("gallery", "old_section", F.when(F.col("n").isNotNull(), place("n", "n")).alias("new_section"))
    last = F.coalesce(F.max("old_section").over(Window.partitionBy()), F.lit(0))
    return known.select("gallery", "old_section", F.coalesce("old_section", last + place("o", "n")).cast("int").alias("new_section"))


def relisted_rows(old: DataFrame, new: DataFrame, overrides: DataFrame, warnings: DataFrame | None = None, galleries: Sequence[str] | None = None, headers: Sequence[str] = (), settings: Catalogue = Catalogue()) -> DataFrame:
    """All that a re-import of ``new`` over ``old`` writes, as rows of SCHEMA.

    * kind "before": each old work, as it was, with its override; ``outcome`` is the match plan's, null out of scope.
    * kind "work": each work afterwards.  New rows of the galleries in scope (all without a list) replace the old
      ones; a row that the plan pairs takes over the include flag and the override of ``from_work``, the last of
      several old works (origin "matched", else "added").  Works of other galleries stay (origin "kept") with their warnings; where ``warnings`` is
      None, these are found anew.  ``ord`` is the place in the list afterwards.
    * kind "list": warnings of the list as a whole: ``headers`` and an empty list's on a whole re-import, else the old ones
      (those in ``warnings`` without a work).

    ``old`` needs work_id, and ord, gallery and include_in_export as ``new``; of the raw columns, those missing
    are null.  ``overrides`` has one row a work.  Both lists are read for the rows, for the match plan and for what
    pairs carry over; what depends on the plan is joined once, and each row's outputs are made where the row is.
    """
    whole = galleries is None
    known = F.lit(True) if whole else F.col("gallery").isin(*galleries)
    before, after = _side(old, True), _side(new, False).where(known)
    rows = before.union(after)
    flat = lambda side: side.where(known).select("ord", "gallery", "include_in_export", "source.*")
    plan = match_plan(flat(before), flat(after))
    ends = F.array(
        F.struct(F.lit(True).alias("old"), F.col("old_ord").alias("ord"), F.col("new_ord").alias("other"), "outcome"),
        F.when(F.col("outcome").isin(*_PAIRED), F.struct(F.lit(False).alias("old"), F.col("new_ord").alias("ord"), F.col("old_ord").alias("other"), "outcome")),
    )
    links = plan.select(F.inline(F.filter(ends, lambda x: x.isNotNull())))
    links = links.groupBy("old", "ord").agg(F.max(F.struct("other", "outcome")).alias("link")).select("old", "ord", "link.*")  # shares the shuffle of the join below

    own = before.select(F.col("ord").alias("own_ord"), F.col("include_in_export").alias("own_include"), "work_id")
    own = own.join(overrides.select(F.col("work_id").cast("string").alias("work_id"), override_struct(overrides).alias("override")), "work_id", "left")
    if warnings is None:
        own = own.withColumn("own_warnings", F.lit(None).cast("array<struct<type: string, message: string>>"))
    else:  # a work has at most one of each type
        of_work = warnings.where("work_id is not null").groupBy(F.col("work_id").cast("string").alias("work_id")).agg(F.sort_array(F.collect_list(F.struct("type", "message"))).alias("own_warnings"))
        own = own.join(of_work, "work_id", "left").withColumn("own_warnings", F.coalesce("own_warnings", F.array().cast("array<struct<type: string, message: string>>")))
    own = own.withColumnRenamed("work_id", "own_work")

    placed = numbered(rows, ["old", "gallery"], "position").join(_sections(rows, whole), "gallery")
    linked = placed.join(links, ["old", "ord"], "left").withColumns({"has": F.col("old") | F.col("other").isNotNull(), "key": F.when(F.col("old"), F.col("ord")).otherwise(F.coalesce("other", "ord"))})
    joined = linked.join(own, (F.col("key") == F.col("own_ord")) & F.col("has"), "left")
    derived = normalise_works(joined.select("*", "source.*"), settings)
    found = found_warnings(settings) if warnings is None else F.when(F.col("old"), F.col("own_warnings")).otherwise(found_warnings(settings))

    def output(kind: str, section: str, **own: Column) -> Column:
        place = F.shiftleft(F.col(section).cast("long"), SECTION_BITS) + F.col("position")
        values = {
            "kind": F.lit(kind), "ord": place, "gallery": F.col("gallery"), "section_position": F.col(section), "position": F.col("position"), "work_id": F.col("work_id"), "from_work": F.lit(None), "origin": F.lit(None), "outcome": F.lit(None),
            "include_in_export": F.col("include_in_export"), "source": F.col("source"), "override": F.col("override"), "warnings": F.lit(None),
        } | own
        return F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA)))

    paired = ~F.col("old") & F.col("has")
    origin = F.when(F.col("old"), "kept").when(paired, "matched").otherwise("added")
    was = output("before", "old_section", outcome=F.col("outcome"))
    now = output("work", "new_section", from_work=F.when(paired, F.col("own_work")), origin=origin, include_in_export=F.when(paired, F.col("own_include")).otherwise(F.col("include_in_export")), warnings=found)
    out = derived.select(F.inline(F.filter(F.array(F.when(F.col("old"), was), F.when(~F.col("old") | ~known, now)), lambda x: x.isNotNull())))

    if whole:
        listed = old.sparkSession.createDataFrame([("missing_column", m) for m in headers], "type string, message string")
        empty = after.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_spreadsheet").alias("type"), F.lit("The list has a header and no rows").alias("message"))
        listed = listed.union(empty)
    else:
        listed = None if warnings is None else warnings.where("work_id is null").select("type", "message")
    if listed is None:
        return out
    lines = listed.select(*(F.array(F.struct("type", "message")).alias("warnings") if f.name == "warnings" else F.lit("list" if f.name == "kind" else None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA)))
    return out.union(lines)


def relisting_counts(rows: DataFrame) -> DataFrame:
    """One row of counts of ``relisted_rows``: matched (by number and by content), added, removed, overrides preserved and at risk."""
    before, scoped, own = F.col("kind") == "before", F.col("outcome").isNotNull(), F.col("override").isNotNull()
    paired = F.coalesce(F.col("outcome").isin(*_PAIRED), F.lit(False))
    counts = {
        "matched": before & paired, "added": (F.col("kind") == "work") & (F.col("origin") == "added"), "removed": before & scoped & ~paired, "overrides_preserved": before & paired & own,
        "matched_by_cat_no": before & (F.col("outcome") == "cat_no"), "matched_by_fingerprint": before & (F.col("outcome") == "fingerprint"), "overrides_at_risk": before & scoped & ~paired & own,
    }
    return rows.agg(*(F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in counts.items()))
