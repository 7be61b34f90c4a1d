"""Registered queries of export, tagged text and reconcile, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Component, Layout
from ..functions import text as T
from ..operators import export, reconcile, reimport, report, tags, works
from ..operators.ordering import in_list_order
from ..sources import files
from ..sources.views import view, with_views
from .oracles import _EFFECTIVE, _MONEY, _normal

PARAGRAPHS = replace(Layout(), section_style="", section_separator="page_break", components=(
    Component("work_number", "space", paragraph="Number"), Component("title", "none"), Component("artist", paragraph="Artist"), Component("edition", paragraph="Edition"), Component("price", "none", paragraph="Price", omit_when_empty=False)))
WRAPPED = replace(Layout(), final_separator_from_last=True, components=(
    Component("work_number"), Component("title", "soft_return", max_line=14, next_after_first_line=True, balance=True), Component("artist"), Component("medium", "hard_return", max_line=10), Component("price", "right_tab")))


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    return works.effective_works(works.normalise_works(works.spread(view(spark, sf, "works"))), view(spark, sf, "overrides"))


def _collected(spark: SparkSession, sf: str) -> DataFrame:
    return export.collected(_effective(spark, sf))


def _new(spark: SparkSession, sf: str) -> DataFrame:
    return export.collected(works.normalise_works(in_list_order(view(spark, sf, "works_new"))))


def export_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = export.numbered(_collected(spark, sf), ["section_position"], "position")
    return rows.drop("ord", "title_cased", "artwork").orderBy("section_position", "position")


def export_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return export.tagged_lines(_collected(spark, sf))


def export_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return export.tagged_lines(_collected(spark, sf), PARAGRAPHS)


def export_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    return export.tagged_lines(_collected(spark, sf), WRAPPED)


def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return export.json_lines(_collected(spark, sf))


def export_xml(spark: SparkSession, sf: str) -> DataFrame:
    return export.xml_lines(_collected(spark, sf))


def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    return export.csv_lines(_collected(spark, sf))


def export_section(spark: SparkSession, sf: str) -> DataFrame:
    """One section's tagged lines."""
    return export.tagged_lines(_collected(spark, sf).where("section = 'Brand#11'"))


def export_names(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "works").select("work_id", F.concat(T.export_slug(F.col("raw_title")), F.lit(".txt")).alias("file_name"))


def works_preview(spark: SparkSession, sf: str) -> DataFrame:
    return export.preview(works.normalise_works(works.spread(view(spark, sf, "works"))))


def _printed(spark: SparkSession, sf: str) -> DataFrame:
    """Entries parsed from the list's own tagged text; exploding keeps filters of the parse from repeating the rendering."""
    lines = export_tagged(spark, sf).select(F.lit("list").alias("document"), (F.col("section_position").cast("long") * (1 << 32) + F.least("position", F.lit((1 << 32) - 1))).alias("ord"), F.explode(F.array("line")).alias("paragraph"))
    return tags.parsed_entries(tags.styles_of(lines))


def parsed_list(spark: SparkSession, sf: str) -> DataFrame:
    return _printed(spark, sf).drop("document", "ord")


def parsed_file(spark: SparkSession, sf: str) -> DataFrame:
    """Entries read back from files of the list's tagged text, in Mac Roman, each file in splits."""
    path = files.scratch_path(spark, "tagged")
    export.write_lines(export_tagged(spark, sf), path, files.LONG, "mac_roman")
    return tags.parsed_entries(tags.styles_of(files.read_document(spark, path))).drop("document", "ord")


def reconcile_findings(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.in_catalogue_order(reconcile.reconcile(_printed(spark, sf), reconcile.display_fields(_new(spark, sf))))


def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.finding_counts(reconcile.reconcile(_printed(spark, sf), reconcile.display_fields(_new(spark, sf))))


def reconcile_works(spark: SparkSession, sf: str) -> DataFrame:
    found = reconcile.reconcile(_printed(spark, sf), reconcile.display_fields(_new(spark, sf))).where("kind <> 'field_change'")
    return reconcile.with_works(found, view(spark, sf, "works")).select("kind", "cat_no", "section", "work_id")


def parse_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.coverage(_printed(spark, sf), _new(spark, sf).where("number is not null"))


EXPORT_FIELDS = ("artist", "honorifics", "title", "price_numeric", "price_text", "edition_total", "edition_price_numeric", "medium", "section")


def export_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What an export of the new list changes against a snapshot of the old one."""
    at = F.lit("2025-01-01").cast("timestamp_ntz")
    snapshot = reimport.snapshot_rows(reimport.export_keys(_collected(spark, sf)), "list", None, at)
    old = reimport.latest_snapshots(snapshot).select("row.*")
    return report.in_key_order(reimport.keyed_diff(old, reimport.export_keys(_new(spark, sf)), EXPORT_FIELDS))


def export_diff_states(spark: SparkSession, sf: str) -> DataFrame:
    """What an export changes for a list with a snapshot, one whose snapshot is the same, and one without any."""
    name = lambda df, series: df.withColumn("series", F.lit(series))
    rows = reimport.export_keys(_new(spark, sf))
    diffs = name(export_snapshot_diff(spark, sf), "list").union(name(reimport.keyed_diff(rows, rows, EXPORT_FIELDS), "same")).union(name(reimport.keyed_diff(rows.limit(0), rows, EXPORT_FIELDS), "new"))
    known = spark.range(2).select(F.when(F.col("id") == 0, "list").otherwise("same").alias("series"))
    return report.diff_summary(diffs, known, known.union(known.select(F.lit("new"))).distinct())


_E = r"replace(replace(replace({0}, '\', '\\'), '<', '\<'), '>', '\>')"
_CS = lambda style, c: f"CASE WHEN coalesce({c}, '') <> '' THEN '<CharStyle:{style}>' || {_E.format(c)} || '<CharStyle:>' ELSE '' END"
_ROWS = rf"""SELECT s.section, s.section_position, x.ord, nullif(cat_no, '') AS number, coalesce(artist_name, '') AS artist, nullif(artist_honorifics, '') AS honorifics, coalesce(title, '') AS title,
  CASE WHEN price_numeric <> 0 THEN price_numeric::BIGINT END AS price_numeric, coalesce(price_text, '') AS price_text, edition_total, CASE WHEN edition_price <> 0 THEN edition_price::BIGINT END AS edition_price_numeric, nullif(medium, '') AS medium
"""
_SECTIONS = lambda source: f"SELECT gallery AS section, row_number() OVER (ORDER BY min(ord))::INT AS section_position FROM {source} GROUP BY gallery"
_SHOWN = f"""coalesce({_MONEY("price_numeric")}, price_text) AS price, CASE WHEN edition_total <> 0 THEN '(edition of ' || edition_total || coalesce(' at ' || {_MONEY("edition_price_numeric")}, '') || ')' ELSE '' END AS edition"""
_COLLECTED = f"""{_EFFECTIVE}, s AS ({_SECTIONS("works")}), c AS ({_ROWS} FROM e x JOIN s ON s.section = x.gallery WHERE include_in_export),
p AS (SELECT *, row_number() OVER (PARTITION BY section_position ORDER BY ord) AS position, {_SHOWN} FROM c), h AS (SELECT DISTINCT section, section_position FROM p)"""
_TAB = lambda value: f"CASE WHEN {value} <> '' THEN {value} || chr(9) ELSE '' END"
_ARTIST = f"({_CS('ArtistName', 'artist')} || CASE WHEN coalesce(honorifics, '') <> '' THEN ' ' || {_CS('Honorifics', 'honorifics')} ELSE '' END)"
_ENTRY = f"""'<ParaStyle:CatalogueEntry>' || {_TAB(_CS('CatNo', 'number'))} || {_TAB(_ARTIST)} || {_TAB(_CS('WorkTitle', 'title'))} || {_TAB(_CS('Edition', 'edition'))} || {_CS('Price', 'price')} || {_CS('Medium', 'medium')}"""
_FOOT = 1 << 62


def _lines(entry: str, head: str | None, foot: str | None, before: str | None = None, after: str | None = None, where: str = "true") -> str:
    parts = [f"SELECT section_position, position, {entry} AS line FROM p WHERE {where}"]
    parts += [f"SELECT section_position, {place}::BIGINT, {text} FROM h WHERE {where}" for text, place in ((head, 0), (foot, _FOOT)) if text is not None]
    parts += [f"SELECT {place}::INT, 0::BIGINT, '{text}'" for text, place in ((before, 0), (after, (1 << 31) - 1)) if text is not None]
    return with_views(f"{_COLLECTED} {' UNION ALL '.join(parts)}", "works", "overrides")


_HEAD = f"'<ParaStyle:SectionTitle>' || {_E.format('section')}"
_XML = lambda c: f"replace(replace(replace(coalesce({c}::VARCHAR, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CSV = lambda c: f"CASE WHEN regexp_matches(coalesce({c}::VARCHAR, ''), '[\",\\r\\n]') THEN '\"' || replace({c}::VARCHAR, '\"', '\"\"') || '\"' ELSE coalesce({c}::VARCHAR, '') END"
_VALUES = {c: c for c in export.COLUMNS} | {"artwork": "NULL"}
_JSON = "to_json({'number': number, 'artist': artist, 'honorifics': honorifics, 'title': title, 'title_cased': '', 'price_numeric': price_numeric, 'price_text': price_text, 'edition_total': edition_total, 'edition_price_numeric': edition_price_numeric, 'artwork': NULL, 'medium': medium})::VARCHAR"
_PARTS = [f"'<ParaStyle:Number>' || {_CS('CatNo', 'number')} || ' ' || {_CS('WorkTitle', 'title')}", f"CASE WHEN {_ARTIST} <> '' THEN '<ParaStyle:Artist>' || {_ARTIST} END", f"CASE WHEN edition <> '' THEN '<ParaStyle:Edition>' || {_CS('Edition', 'edition')} END", f"'<ParaStyle:Price>' || {_CS('Price', 'price')}"]
_FIELDS = ("artist", "honorifics", "title", "edition", "price", "medium")
_LOW = lambda c: rf"trim(regexp_replace(replace(replace(translate(coalesce({c}, ''), '‘’‚‛′“”„″', '''''''''''\"\"\"\"'), chr(13), ''), chr(10), ''), '\s+', ' ', 'g'))"
_RECONCILE = f"""{_COLLECTED}, {_normal("works_new", "m")}, s2 AS ({_SECTIONS("works_new")}), c2 AS ({_ROWS} FROM m x JOIN s2 s ON s.section = x.gallery WHERE include_in_export), p2 AS (SELECT *, {_SHOWN} FROM c2),
lo AS (SELECT number, arg_max(p, section_position::BIGINT * 4294967296 + position) AS l, max(section_position::BIGINT * 4294967296 + position) AS pos FROM p WHERE number IS NOT NULL GROUP BY number), da AS (SELECT number, arg_max(p2, ord) AS d FROM p2 WHERE number IS NOT NULL GROUP BY number),
j AS (SELECT coalesce(lo.number, da.number) AS cat_no, l, d, pos FROM lo FULL JOIN da ON lo.number = da.number),
a AS (SELECT section, other AS aligned FROM (SELECT d.section AS section, l.section AS other, count(*) AS k, min(pos) AS first FROM j WHERE d IS NOT NULL AND l IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY section ORDER BY k DESC, first, other) = 1),
f AS ({" UNION ALL ".join(f"SELECT 'field_change' AS kind, cat_no, '{f}' AS field, coalesce(d.{f}, '') AS db_value, coalesce(l.{f}, '') AS low_value, d.section AS section, CASE WHEN {_LOW(f'd.{f}')} = {_LOW(f'l.{f}')} THEN 'cosmetic' ELSE 'medium' END AS severity, 'override' AS fix_channel FROM j WHERE d IS NOT NULL AND l IS NOT NULL AND coalesce(d.{f}, '') <> coalesce(l.{f}, '')" for f in _FIELDS)}
 UNION ALL SELECT 'room_move', cat_no, NULL, d.section, l.section, l.section, 'high', 'spreadsheet' FROM j JOIN a ON a.section = d.section WHERE l IS NOT NULL AND l.section <> aligned
 UNION ALL SELECT 'entry_added', cat_no, NULL, NULL, l.title, l.section, 'high', 'spreadsheet' FROM j WHERE d IS NULL UNION ALL SELECT 'entry_removed', cat_no, NULL, d.title, NULL, d.section, 'high', 'spreadsheet' FROM j WHERE l IS NULL
 UNION ALL SELECT 'section_rename', NULL, NULL, section, aligned, aligned, 'info', 'spreadsheet' FROM a WHERE section <> aligned)"""
_VS = ("works", "overrides", "works_new")


def _keys(source: str, order: str) -> str:
    return f"SELECT *, CASE WHEN number IS NULL THEN '__unnamed_' || row_number() OVER (PARTITION BY number IS NULL ORDER BY section_position, ord) WHEN row_number() OVER (PARTITION BY number ORDER BY section_position, ord) = 1 THEN number ELSE number || '__pos' || section_position || '_' || (row_number() OVER (PARTITION BY section_position ORDER BY ord) - 1) END AS key FROM {source}"


_SNAPSHOT = f"""{_COLLECTED}, {_normal("works_new", "m")}, s2 AS ({_SECTIONS("works_new")}), c2 AS ({_ROWS} FROM m x JOIN s2 s ON s.section = x.gallery WHERE include_in_export), a AS ({_keys("c", "ord")}), b AS ({_keys("c2", "ord")}),
d AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS kind,
 array_to_string(list_filter([{", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in EXPORT_FIELDS)}], lambda x: x IS NOT NULL), ',') AS c FROM a FULL JOIN b ON a.key = b.key)"""
_N = _normal("works", "n")

QUERIES = {f.__name__: f for f in (
    export_order, export_tagged, export_paragraphs, export_wrapped, export_json, export_xml, export_csv, export_section, export_names, works_preview,
    parsed_list, parsed_file, reconcile_findings, reconcile_counts, reconcile_works, parse_coverage, export_snapshot_diff, export_diff_states,
)}

ORACLES = {
    "export_order": with_views(f"{_COLLECTED} SELECT section, section_position, number, artist, honorifics, title, price_numeric, price_text, edition_total, edition_price_numeric, medium, position FROM p", "works", "overrides"),
    "export_tagged": _lines(_ENTRY, _HEAD, "''", "<ASCII-MAC>"),
    "export_section": _lines(_ENTRY, _HEAD, "''", "<ASCII-MAC>", where="section = 'Brand#11'"),
    "export_paragraphs": _lines(f"concat_ws(chr(13), {', '.join(_PARTS)})", None, "'<cnxc:Page>'", "<ASCII-MAC>"),
    "export_json": _lines(f"CASE WHEN position > 1 THEN ',' ELSE '' END || {_JSON}", """CASE WHEN section_position > 1 THEN ',' ELSE '' END || '{"section_name":' || to_json(section)::VARCHAR || ',"position":' || section_position || ',"works":['""", "']}'", '{"sections":[', "]}"),
    "export_xml": _lines("'<work>' || " + " || ".join(f"'<{c}>' || {_XML(v)} || '</{c}>'" for c, v in _VALUES.items()) + " || '</work>'", """'<section name="' || """ + _XML("section") + """ || '" position="' || section_position || '">'""", "'</section>'", "<catalogue>", "</catalogue>"),
    "export_csv": _lines(" || ',' || ".join(_CSV(c) for c in ("section", *_VALUES.values())), None, None, ",".join(("section", *export.COLUMNS))),
    "export_names": with_views("SELECT work_id, coalesce(nullif(regexp_replace(regexp_replace(raw_title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'export') || '.txt' AS file_name FROM works", "works"),
    "works_preview": with_views(f"WITH {_N} SELECT work_id, cat_no, concat_ws(' ', artist_name, artist_honorifics) AS artist, title, coalesce({_MONEY('price_numeric')}, nullif(price_text, '')) AS price, CASE WHEN edition_total <> 0 THEN '(edition of ' || edition_total || coalesce(' at ' || {_MONEY('edition_price')}, '') || ')' END AS edition, medium FROM n", "works"),
    "parsed_list": with_views(f"{_COLLECTED} SELECT section, number AS cat_no, {', '.join(f'''nullif({f}, '') AS {f}''' for f in _FIELDS)} FROM p WHERE number IS NOT NULL", "works", "overrides"),
    "parsed_file": with_views(f"{_COLLECTED} SELECT section, number AS cat_no, {', '.join(f'''nullif({f}, '') AS {f}''' for f in _FIELDS)} FROM p WHERE number IS NOT NULL", "works", "overrides"),
    "reconcile_findings": with_views(f"{_RECONCILE} SELECT * FROM f", *_VS),
    "reconcile_counts": with_views(f"{_RECONCILE} SELECT severity, fix_channel, count(*) AS n FROM f GROUP BY ALL", *_VS),
    "reconcile_works": with_views(f"{_RECONCILE}, w AS (SELECT cat_no, arg_min(work_id, ord) AS work_id FROM works WHERE cat_no IS NOT NULL GROUP BY cat_no) SELECT kind, f.cat_no, section, work_id FROM f LEFT JOIN w ON w.cat_no = f.cat_no WHERE kind <> 'field_change'", *_VS),
    "parse_coverage": with_views(f"{_RECONCILE}, z AS (SELECT (SELECT count(*) FROM p WHERE number IS NOT NULL) AS printed, (SELECT count(*) FROM p2 WHERE number IS NOT NULL) AS in_data) SELECT *, in_data > 0 AND 2 * printed < in_data AS suspicious FROM z", *_VS),
    "export_snapshot_diff": with_views(f"{_SNAPSHOT} SELECT key, kind, CASE WHEN kind = 'changed' THEN c END AS changed FROM d WHERE kind <> 'changed' OR c <> ''", *_VS),
    "export_diff_states": with_views(f"{_SNAPSHOT}, moved AS (SELECT kind FROM d WHERE kind <> 'changed' OR c <> '') SELECT 'list' AS series, CASE WHEN count(*) > 0 THEN 'changed' ELSE 'unchanged' END AS state, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'changed') AS changed FROM moved UNION ALL SELECT 'same', 'unchanged', 0, 0, 0 UNION ALL SELECT 'new', 'no_previous_export', 0, 0, 0", *_VS),
}
