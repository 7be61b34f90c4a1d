"""States of a works list over time: applying a re-import, snapshots, restoring, and edits as audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .match import match_plan
from .ordering import numbered, ties


def in_scope(works: DataFrame, galleries: list[str] | None) -> DataFrame:
    """Works of some galleries, all without a list; works without a gallery are in "Uncategorised"."""
    name = F.coalesce(T.blank_to_null(F.col("gallery")), F.lit("Uncategorised"))
    return works if galleries is None else works.where(name.isin(*galleries))


def out_of_scope(works: DataFrame, galleries: list[str]) -> DataFrame:
    name = F.coalesce(T.blank_to_null(F.col("gallery")), F.lit("Uncategorised"))
    return works.where(~name.isin(*galleries))


def apply_reimport(old: DataFrame, new: DataFrame, overrides: DataFrame, galleries: list[str] | None = None) -> DataFrame:
    """The works after a re-import: (ord, gallery, section_position, position, origin, old_work, include_in_export).

    Works of other galleries stay as they are (origin "kept").  New rows of the galleries in
    scope replace the old ones; those that the match plan pairs take over the old work's
    include flag and override (``old_work`` names it where it has an override).  Sections keep
    their positions, new ones follow behind the last.  New rows of one ``ord`` are in the order of
    ``seq``, if they have it.
    """
    uncategorised = F.coalesce(T.blank_to_null(F.col("gallery")), F.lit("Uncategorised")).alias("gallery")
    scoped_old, scoped_new = in_scope(old, galleries), in_scope(new, galleries)
    sections = old.select(uncategorised, "ord").groupBy("gallery").agg(F.min("ord").alias("first")).select("gallery", F.row_number().over(Window.orderBy("first")).alias("section_position"))  # one row a section
    fresh = scoped_new.select(uncategorised, "ord").groupBy("gallery").agg(F.min("ord").alias("first")).join(sections, "gallery", "left")
    if galleries is None:  # everything is rebuilt, so positions start anew
        places = fresh.select("gallery", F.row_number().over(Window.orderBy("first")).alias("section_position"))
    else:
        last = sections.agg(F.coalesce(F.max("section_position"), F.lit(0))).first()[0]
        known = fresh.where("section_position is not null").select("gallery", "section_position")
        added = fresh.where("section_position is null").withColumn("k", F.row_number().over(Window.orderBy("first")))
        places = known.union(added.select("gallery", (F.col("k") + last).cast("int")))
    plan = match_plan(scoped_old, scoped_new).where("outcome in ('cat_no', 'fingerprint')").groupBy("new_ord").agg(F.max("old_ord").alias("old_ord"))  # of repeats in the old list, the last
    kept = scoped_old.select(F.col("ord").alias("old_ord"), F.col("include_in_export").alias("old_include"), "work_id").join(overrides.select("work_id", F.lit(True).alias("overridden")), "work_id", "left")
    paired = plan.join(kept, "old_ord")
    rows = scoped_new.select("ord", uncategorised, "include_in_export", *ties(new)).join(paired, F.col("ord") == F.col("new_ord"), "left").join(places, "gallery")
    out = numbered(rows, ["gallery"], "position", then=ties(new)).select(
        "ord", "gallery", "section_position", "position", F.when(F.col("old_ord").isNotNull(), "matched").otherwise("added").alias("origin"),
        F.when(F.col("overridden"), F.col("work_id")).alias("old_work"), F.coalesce("old_include", "include_in_export").alias("include_in_export"),
    )
    if galleries is None:
        return out
    rest = numbered(out_of_scope(old, galleries).select("ord", "work_id", uncategorised, "include_in_export").join(sections, "gallery"), ["gallery"], "position").join(overrides.select("work_id", F.lit(True).alias("overridden")), "work_id", "left")
    return out.unionByName(rest.select("ord", "gallery", "section_position", "position", F.lit("kept").alias("origin"), F.when(F.col("overridden"), F.col("work_id")).alias("old_work"), "include_in_export"))


def snapshot_rows(state: DataFrame, import_id: str, template: str | None, at: Column) -> DataFrame:
    """A state as rows of an append-only table of snapshots: import, template (may be null), time, and the row as a struct."""
    return state.select(F.lit(import_id).alias("import_id"), F.lit(template).cast("string").alias("template"), at.alias("at"), F.struct(*state.columns).alias("row"))


def latest_snapshots(snapshots: DataFrame, keys: tuple[str, ...] = ("import_id", "template"), at: str = "at") -> DataFrame:
    """All rows of the newest snapshot of each import and template, null being a template."""
    newest = snapshots.groupBy(*keys).agg(F.max(at).alias("_newest")).withColumnsRenamed({k: f"_{k}" for k in keys})  # one row a snapshot series
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col(at) == F.col("_newest"))
    return snapshots.join(newest, same).select(*snapshots.columns)


def restored(current: DataFrame, snapshots: DataFrame, import_id: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The state of the newest snapshot of an import, and the snapshot of the current state to append before it is replaced."""
    before = snapshot_rows(current, import_id, "pre_restore", at)
    newest = latest_snapshots(snapshots.where(F.col("import_id") == import_id), ("import_id",))
    return newest.select("row.*"), before


def export_keys(rows: DataFrame) -> DataFrame:
    """Adds ``key`` to collected rows: the number, ``__unnamed_n`` without one, and the place behind it for repeats (of one ``ord`` by ``seq``, if the rows have it)."""
    placed = numbered(rows.where("ord is not null"), ["section_position"], "position", then=ties(rows))
    order = F.col("section_position").cast("long") * F.lit(1 << 40) + F.col("position")
    placed = placed.withColumns({"_order": order, "_named": F.col("number").isNotNull()})
    unnamed = numbered(placed.where("not _named"), ["_named"], "_k", "_order").withColumn("key", F.concat(F.lit("__unnamed_"), F.col("_k").cast("string"))).drop("_k")
    named = placed.where("_named").join(placed.where("_named").groupBy(F.col("number").alias("_number")).agg(F.min("_order").alias("_first")), F.col("number") == F.col("_number")).drop("_number")
    place = F.concat("number", F.lit("__pos"), F.col("section_position").cast("string"), F.lit("_"), (F.col("position") - 1).cast("string"))
    named = named.withColumn("key", F.when(F.col("_order") == F.col("_first"), F.col("number")).otherwise(place)).drop("_first")
    return named.unionByName(unnamed).drop("_order", "_named", "position")


def keyed_diff(before: DataFrame, after: DataFrame, fields: tuple[str, ...], key: str = "key") -> DataFrame:
    """(key, kind, changed): rows added, removed or changed, by a key that is unique on either side."""
    both = before.select(key, F.struct(*fields).alias("old")).join(after.select(key, F.struct(*fields).alias("new")), key, "full")
    changed = F.filter(F.array(*(F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select(F.col(key).alias("key"), kind.alias("kind"), F.when(kind == "changed", F.array_join(changed, ",")).alias("changed")).where("kind is not null")


INDEX_FIELDS = ("title", "first_name", "last_name", "quals", "company", *(f"artist{k}_{p}" for k in (2, 3) for p in ("first_name", "last_name", "quals")), "artist1_ra_styled", "artist2_ra_styled", "artist3_ra_styled", "is_ra_member", "is_company", "numbers")


def index_entry_keys(entries: DataFrame) -> DataFrame:
    """Adds ``key`` to index entries: sort key and courtesy, and the number of the repeat behind it."""
    base = entries.withColumn("base", F.concat(F.coalesce("sort_key", F.lit("")), F.lit("::"), F.coalesce("courtesy", F.lit(""))))
    ranked = numbered(base, ["base"], "k", "row_number")
    return ranked.withColumn("key", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("__dup"), (F.col("k") - 1).cast("string")))).drop("base", "k")


def override_edits(before: DataFrame, after: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, action, field, old_value, new_value): an audit row for each field that an edit of overrides moved.

    A key without any row afterwards was deleted, one without any before was set.
    """
    fields = [c for c in before.columns if c != key and c in after.columns]
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    both = before.select(key, F.struct(F.lit(True).alias("there"), *fields).alias("a")).join(after.select(key, F.struct(F.lit(True).alias("there"), *fields).alias("b")), key, "full")
    action = F.when(F.col("b").isNull(), "override_deleted").otherwise("override_set")
    moved = [F.when(~text("a", f).eqNullSafe(text("b", f)), F.struct(F.lit(f).alias("field"), text("a", f).alias("old_value"), text("b", f).alias("new_value"))) for f in fields]
    return both.select(key, action.alias("action"), F.explode(F.filter(F.array(*moved), lambda x: x.isNotNull())).alias("e")).select(key, "action", "e.*")


def edit_audit(before: DataFrame, after: DataFrame, key: str = "row_number") -> DataFrame:
    """(key, action, field, old_value, new_value): the audit rows of edits of index overrides.

    A row that is new or moved gives "override_set" for each field that isn't as before, one that is gone a
    single "override_deleted" without a field.  Booleans are written True and False.
    """
    fields = [c for c in after.columns if c != key and c in before.columns]
    kinds = dict(after.dtypes)
    text = lambda side, f: F.initcap(F.col(f"{side}.{f}").cast("string")) if kinds[f] == "boolean" else F.col(f"{side}.{f}").cast("string")
    row = lambda action, field, old, new: F.struct(F.lit(action).alias("action"), F.lit(field).cast("string").alias("field"), old.alias("old_value"), new.alias("new_value"))
    both = before.select(key, F.struct(F.lit(True).alias("there"), *fields).alias("a")).join(after.select(key, F.struct(F.lit(True).alias("there"), *fields).alias("b")), key, "full")
    moved = F.filter(F.array(*(F.when(~text("a", f).eqNullSafe(text("b", f)), row("override_set", f, text("a", f), text("b", f))) for f in fields)), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    return both.select(key, F.inline(F.when(F.col("b").isNull(), F.array(row("override_deleted", None, none, none))).otherwise(moved)))


def toggle_audit(artists: DataFrame, edits: DataFrame, toggles: DataFrame, key: str = "row_number") -> DataFrame:
    """(key, action, field, old_value, new_value) of the toggles (key, exclude, is_company) that change something; null asks for nothing.

    Whether an artist is a company is so far what its edit says, or else what its row does.
    """
    now = artists.select(key, F.coalesce("include_in_export", F.lit(False)).alias("_shown"), F.coalesce("is_company", F.lit(False)).alias("_auto")).join(edits.select(key, F.col("is_company_override").alias("_edit")), key, "left")
    asked = now.join(toggles.select(key, "exclude", F.col("is_company").alias("_company")), key).withColumn("_is", F.coalesce("_edit", "_auto"))
    said = lambda c: F.initcap(c.cast("string"))
    row = lambda test, action, field, old, new: F.when(test, F.struct(action.alias("action"), F.lit(field).alias("field"), said(old).alias("old_value"), said(new).alias("new_value")))
    shown = row(F.col("exclude") == F.col("_shown"), F.when(F.col("exclude"), "index_artist_excluded").otherwise("index_artist_included"), "include_in_export", F.col("_shown"), ~F.col("exclude"))
    company = row(F.col("_company") != F.col("_is"), F.when(F.col("_company"), "index_artist_company_set").otherwise("index_artist_company_unset"), "is_company_override", F.col("_is"), F.col("_company"))
    return asked.select(key, F.inline(F.filter(F.array(shown, company), lambda x: x.isNotNull())))


def include_toggles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(work_id, action): works that were put in or left out."""
    both = before.select("work_id", F.col("include_in_export").alias("old")).join(after.select("work_id", F.col("include_in_export").alias("new")), "work_id").where("old <> new")
    return both.select("work_id", F.when(F.col("new"), "included").otherwise("excluded").alias("action"))


def seeded(current: DataFrame, seeds: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action): what a set of seeds does to a table of seeded rows, by content hash: insert, update, delete or keep."""
    old = current.select(key, F.sha2(F.col(content), 256).alias("old"))
    new = seeds.select(key, F.sha2(F.col(content), 256).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return old.join(new, key, "full").select(key, action.alias("action"))
