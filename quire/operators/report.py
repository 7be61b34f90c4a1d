"""Reports over lists, artists, warnings and audit rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def list_stats(works: DataFrame, overrides: DataFrame, imports: DataFrame) -> DataFrame:
    """(import_id, sections, works, overrides, newest_override) of each import, zeros where it has nothing; newest import first."""
    own = works.groupBy("import_id").agg(F.count_distinct("gallery").alias("sections"), F.count("*").alias("works"))
    edited = works.select("import_id", "work_id").join(overrides.select("work_id", "updated_at"), "work_id").groupBy("import_id").agg(F.count("*").alias("overrides"), F.max("updated_at").alias("newest_override"))
    out = imports.join(own, "import_id", "left").join(edited, "import_id", "left")
    return out.select("import_id", "uploaded_at", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sections", "works", "overrides")), "newest_override").orderBy(F.desc("uploaded_at"), "import_id")


def warnings_with_works(warnings: DataFrame, works: DataFrame) -> DataFrame:
    """Warnings beside their work, if they have one, in the order they came."""
    return warnings.join(works.select("work_id", "cat_no", "gallery"), "work_id", "left")


def warnings_with_artists(messages: DataFrame, artists: DataFrame) -> DataFrame:
    """Warnings beside the artist whose row their message names ("Row 7: ..."); the last artist of a row counts."""
    number = F.regexp_extract("message", r"^Rows? ([0-9]+)", 1).try_cast("long")
    last = artists.groupBy(F.col("row_number").alias("row")).agg(F.max("artist_id").alias("artist_id"))
    return messages.withColumn("row", number).join(last, "row", "left")


#: Order of warnings in a summary: severe types first.
SEVERE = ("missing_title", "missing_artist", "unrecognised_price", "edition_anomaly")


def warning_summary(warnings: DataFrame) -> DataFrame:
    """(type, severe, n), severe ones first, then by count."""
    counted = warnings.groupBy("type").agg(F.count("*").alias("n")).withColumn("severe", F.col("type").isin(*SEVERE))
    return counted.select("type", "severe", "n").orderBy(F.desc("severe"), F.desc("n"), "type")


def hidden(rows: DataFrame, column: str, hide: list[str] = [], solo: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of categories that aren't hidden; with ``solo``, only of those."""
    out = rows.where(F.col(column).isin(*solo)) if solo else rows
    return out.where(~F.col(column).isin(*hide)) if hide else out


def audit_report(audit: DataFrame, works: DataFrame, artists: DataFrame, templates: DataFrame, most: int | None = 200) -> DataFrame:
    """Audit rows beside the work, artist and template they name; the newest ``most`` (1 to 1000), or all with None."""
    rows = audit if most is None else audit.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(1000, most)))
    out = rows.join(works.select("work_id", "cat_no", F.col("raw_title").alias("title")), "work_id", "left")
    out = out.join(artists.select("artist_id", "last_name"), "artist_id", "left")
    return out.join(templates.select("template_id", F.col("name").alias("template")), "template_id", "left")


def audit_by_import(audit: DataFrame, imports: DataFrame) -> DataFrame:
    """(import_id, name, events, users, newest): audit rows of each import, those without a known one under null."""
    own = audit.join(imports.select("import_id", "name"), "import_id", "left")
    return own.groupBy("import_id", "name").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("newest"))


BUCKETS = {"exact": "match", "equivalent": "match", "partial_title": "title", "partial_honorific": "honorific", "partial_ra": "ra", "partial_name": "name"}


def level_buckets(entries: DataFrame) -> DataFrame:
    """(bucket, n): levels of a comparison in six buckets; what one side lacks is missing."""
    known = reduce(lambda c, kv: c.when(F.col("level") == kv[0], kv[1]), BUCKETS.items(), F.when(F.col("differences").startswith("missing_in"), "missing"))
    return entries.groupBy(known.otherwise("none").alias("bucket")).agg(F.count("*").alias("n"))


def merged_from_rows(numbers: DataFrame) -> DataFrame:
    """(row_number, merged_from): the distinct source rows of an artist's numbers, null where it is one row."""
    rows = F.sort_array(F.collect_set("source_row"))
    return numbers.groupBy("row_number").agg(rows.alias("rows")).select("row_number", F.when(F.size("rows") > 1, F.array_join(F.transform("rows", lambda x: x.cast("string")), ",")).alias("merged_from"))


def courtesy_groups(numbers: DataFrame) -> DataFrame:
    """(row_number, courtesy, numbers): catalogue numbers of each artist and courtesy in order, null courtesy first."""
    own = numbers.withColumn("courtesy", T.blank_to_null(F.col("courtesy"))).groupBy("row_number", "courtesy").agg(F.sort_array(F.collect_list("cat_no")).alias("numbers"))
    return own.orderBy("row_number", F.col("courtesy").asc_nulls_first())


def orphans(uploads: DataFrame, imports: DataFrame) -> DataFrame:
    """Stored files that no import names."""
    return uploads.join(imports.select(F.col("stored_as").alias("path")), "path", "left_anti")


def storage_stats(uploads: DataFrame) -> DataFrame:
    """One row: files and their total size."""
    return uploads.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def listed_files(spark, path: str) -> DataFrame:
    """(path, size, modified) of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def duplicate_names(uploads: DataFrame, imports: DataFrame) -> DataFrame:
    """Uploads whose name an import has already."""
    return uploads.join(imports.select("name").distinct(), "name", "left_semi")


def work_changes(normalised: DataFrame) -> DataFrame:
    """(work_id, reasons): why derived columns differ from the raw ones, for display."""
    c = F.col
    moved = lambda f: ~T.strip(c(f"raw_{f}")).eqNullSafe(c(f))
    trimmed = lambda f: F.coalesce(c(f"raw_{f}") != T.strip(c(f"raw_{f}")), F.lit(False))
    cases: dict[str, Column] = {
        "title trimmed": trimmed("title"), "title substituted": moved("title"), "artist trimmed": trimmed("artist"), "honorifics extracted": c("artist_honorifics").isNotNull(),
        "medium trimmed": trimmed("medium"), "edition suppressed": F.coalesce(c("raw_edition").rlike("^Edition of [0-9]"), F.lit(False)) & c("edition_total").isNull(),
    }
    found = F.filter(F.array(*(F.when(case, F.lit(name)) for name, case in cases.items())), lambda x: x.isNotNull())
    return normalised.select("work_id", F.array_join(found, "; ").alias("reasons"))


def index_changes(parsed: DataFrame) -> DataFrame:
    """(row_number, reasons): why fields of parsed index rows differ from the raw ones, for display."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    labels = {"title": "Title", "last_name": "Last Name", "first_name": "First Name", "quals": "Quals", "company": "Company"}
    spaced = {f: (c(f"raw_{f}") != c(f)) & (T.strip(c(f"raw_{f}")) == T.strip(c(f))) for f in labels}
    moved = {f: T.strip(c(f"raw_{f}")) != T.strip(c(f)) for f in labels}
    named = lambda which: T.blank_to_null(F.concat_ws(", ", *(F.when(case, F.lit(labels[f])) for f, case in which.items())))
    second = F.col("artist2_first_name").isNotNull() | F.col("artist2_last_name").isNotNull()
    reasons = [
        F.concat(F.lit("Whitespace trimmed: "), named(spaced)), F.concat(F.lit("Values changed: "), named(moved)), F.when(F.col("is_company"), "Auto-detected as company (no first name)"),
        F.when(second & F.lower(T.strip(c("raw_last_name"))).rlike("^(?:and|&) "), "Multi-artist entry parsed (second artist extracted from Last Name)"),
    ]
    return parsed.select("row_number", F.concat_ws("; ", *reasons).alias("reasons"))


def in_key_order(diff: DataFrame) -> DataFrame:
    """A keyed diff by its keys' bytes."""
    return diff.orderBy("key")


def in_time_order(rows: DataFrame, at: str = "created_at") -> DataFrame:
    """Rows by the time they came, the oldest first; rows of one time by all they have."""
    return rows.orderBy(at, *(x for x in rows.columns if x != at))


def in_time_order_of(rows: DataFrame, found: Callable[[DataFrame], DataFrame], at: str = "created_at", key: str = "work_id") -> DataFrame:
    """What ``found`` makes of rows one by one, as ``in_time_order`` has it; ``found`` keeps the time and the key, and adds rows or columns.

    Rows are put in ranges as they are, so ``found`` is computed once, not for the bounds of the
    ranges too, and by as many tasks as there are ranges.
    """
    out = found(rows.repartitionByRange(at, key))
    return out.sortWithinPartitions(at, key, *(x for x in out.columns if x not in (at, key)))


def diff_summary(diffs: DataFrame, snapshots: DataFrame, series: DataFrame) -> DataFrame:
    """(series, state, added, removed, changed) of each of ``series``: no_previous_export where it has no snapshot, else changed or unchanged.

    ``diffs`` are rows of keyed diffs with their series.
    """
    kinds = ("added", "removed", "changed")
    counts = diffs.groupBy("series").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    own = series.join(snapshots.select("series", F.lit(True).alias("there")).distinct(), "series", "left").join(counts, "series", "left")
    known = [F.when(F.col("there"), F.coalesce(k, F.lit(0))).otherwise(0).cast("long").alias(k) for k in kinds]
    state = F.when(F.col("there").isNull(), "no_previous_export").when(F.coalesce(sum((F.col(k) for k in kinds), F.lit(0)), F.lit(0)) > 0, "changed").otherwise("unchanged")
    return own.select("series", state.alias("state"), *known)


def title_reasons(normalised: DataFrame, exceptions: tuple[str, ...]) -> DataFrame:
    """(work_id, token, reason): words of titles that title case leaves alone; an exception goes before a Roman numeral, each word once."""
    tokens = F.array_distinct(F.transform(T.title_tokens(F.col("title")), F.upper))
    rows = normalised.select("work_id", F.explode(tokens).alias("token"))
    reason = F.when(F.col("token").isin(*(x.upper() for x in exceptions)), "exception").when(T.looks_roman(F.col("token")), "roman")
    return rows.withColumn("reason", reason).where("reason is not null")


def newest_settings(settings: DataFrame) -> DataFrame:
    """The newest row of settings of each kind; thresholds outside of 0 to 10 don't count."""
    own = settings.where(F.col("threshold").between(0, 10))
    return own.groupBy("kind").agg(F.max_by(F.struct("threshold", "at"), F.struct("at", "threshold")).alias("s")).select("kind", "s.*")


def rule_export(rules: DataFrame, match: tuple[str, ...], resolved: tuple[str, ...]) -> DataFrame:
    """(json) of known-artist rules without their nulls, by last and first name."""
    return rules.orderBy(*match).select(*match, F.to_json(F.struct(*match, *resolved)).alias("json"))


def detail_tree(works: DataFrame, overrides: DataFrame, sections: DataFrame) -> DataFrame:
    """Works of every section beside their override, with the fields it changes; sections without works stay.

    The tree's nodes are rows in order, so a section of any size is no single value.
    """
    changed = F.concat_ws(",", *(F.when(F.col(c).isNotNull(), F.lit(c.removesuffix("_override"))) for c in overrides.columns if c.endswith("_override")))
    own = overrides.select("work_id", changed.alias("overridden"))
    named = works.withColumn("gallery", F.coalesce(T.blank_to_null(F.col("gallery")), F.lit("Uncategorised")))
    return sections.join(named.join(own, "work_id", "left"), "gallery", "left").select("gallery", "section_position", "work_id", "ord", "cat_no", "overridden")


def template_listing(templates: DataFrame, kind: str) -> DataFrame:
    """Templates of a kind that aren't archived, built-in ones first, then by name."""
    return templates.where((F.col("kind") == kind) & ~F.col("archived")).orderBy(F.desc("builtin"), "name").select("template_id", "name", "builtin")


def template_export(templates: DataFrame) -> DataFrame:
    """(template_id, file_name, json) of templates that aren't archived: the name as ``_name`` before the settings of ``config``, a JSON object.

    Files are named after the slug, or the name where there is none.  A null or empty config has no settings.
    """
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("name").alias("s"))), r'(?s)^\{"s":(.*)\}$', "$1")
    inner = F.regexp_extract(F.trim(F.coalesce("config", F.lit(""))), r"(?s)^\{\s*(.*?)\s*\}$", 1)
    body = F.concat(F.lit('{"_name":'), F.when(F.col("name").isNull(), "null").otherwise(quoted), F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(""), F.lit("}"))
    named = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return templates.where("not archived").select("template_id", F.concat(F.coalesce(T.blank_to_null(F.col("slug")), named), F.lit(".json")).alias("file_name"), body.alias("json"))


def template_import(files: DataFrame) -> DataFrame:
    """(slug, name, config) of files of JSON (path, value): ``_name`` is the name, all other settings the config, as they are written.

    The slug is the file's name without its ending.  A file without a name takes its slug; one that isn't an object has no config.
    """
    slug = F.regexp_extract("path", r"([^/\\]*?)(?:\.json)?$", 1)
    held = F.try_variant_get(F.try_parse_json("value"), "$._name", "string")
    rest = F.regexp_replace(F.trim("value"), r'(?s)^\{\s*"_name"\s*:\s*(?:null|"(?:[^"\\]|\\.)*")\s*,?\s*', "{")
    config = F.when(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"(?s)^\s*\{"), F.regexp_replace(rest, r"\s+$", ""))
    return files.select(slug.alias("slug"), F.coalesce(held, slug).alias("name"), config.alias("config"))
