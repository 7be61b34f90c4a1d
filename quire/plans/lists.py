"""Registered queries over a list that is imported, overridden and imported again, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relisting import SECTION_BITS
from ..sources.files import scratch_path
from ..sources.lists import ListStore
from ..sources.views import view, with_views
from .oracles import _N, _WARN, _normal
from .reports import _G, _SCOPED, _SECTION, SCOPE

LIST = "list"


def _imported(spark: SparkSession, sf: str) -> ListStore:
    """A list with overrides after some of its galleries were imported again; the last write is repeated."""
    store = ListStore(spark, scratch_path(spark, "lists"))
    store.reimport(view(spark, sf, "works"), LIST, datetime(2025, 1, 1), "first")
    works = store.works(LIST).select(F.col("work_id").alias("own"), F.col("cat_no").cast("long").alias("work_id"))
    edits = view(spark, sf, "overrides").withColumn("work_id", F.col("work_id").cast("long")).join(works, "work_id").drop("work_id").withColumnRenamed("own", "work_id")
    store.override(edits, LIST, datetime(2025, 1, 2))
    for _ in range(2):
        store.reimport(view(spark, sf, "works_new"), LIST, datetime(2025, 1, 3), "second", SCOPE)
    return store


def reimported_works(spark: SparkSession, sf: str) -> DataFrame:
    """The works after the re-import, with the fields that overrides and normalisation give them."""
    store = _imported(spark, sf)
    effective = store.effective(LIST).select("ord", "title", "artist_name", F.col("price_numeric").cast("long").alias("price_numeric"), "price_text", "medium")
    return store.works(LIST).select("ord", "gallery", "section_position", "position", "cat_no", "origin", "from_work", "include_in_export").join(effective, "ord").drop("ord")


def reimported_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """The warnings after the re-import: found anew for its rows, kept for other works."""
    store = _imported(spark, sf)
    return store.warnings(LIST).join(store.works(LIST).select("work_id", "section_position", "position"), "work_id").select("section_position", "position", "type")


def works_before_reimport(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot that the re-import took, with the outcome of each work in scope."""
    return _imported(spark, sf).before(LIST).select("gallery", "section_position", "position", "cat_no", "outcome", F.col("override").isNotNull().alias("overridden"))


def reimport_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit rows of all three writes."""
    return _imported(spark, sf).audit(LIST).drop("import_id")


QUERIES = {f.__name__: f for f in (reimported_works, reimported_warnings, works_before_reimport, reimport_audit)}

_RAW = "cat_no, raw_title, raw_artist, raw_price, raw_edition, raw_medium"
_PLACE = 1 << SECTION_BITS
_STATE = f"""WITH s AS ({_SECTION}), stored AS (SELECT works.* REPLACE (section_position * {_PLACE} + row_number() OVER (PARTITION BY works.gallery ORDER BY works.ord) AS ord), section_position FROM works JOIN s ON s.gallery = works.gallery),
{_SCOPED.replace("FROM works WHERE", "FROM stored WHERE").removeprefix("WITH ")}, g AS (SELECT gallery, min(ord) AS first FROM works_new WHERE gallery IN {_G} GROUP BY 1),
places AS (SELECT g.gallery, coalesce(s.section_position, (SELECT max(section_position) FROM s) + sum(CASE WHEN s.gallery IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY first))::INT AS section_position FROM g LEFT JOIN s ON s.gallery = g.gallery),
q AS (SELECT new_ord, old_ord, work_id, include_in_export FROM plan JOIN stored ON stored.ord = old_ord WHERE outcome IN ('cat_no', 'fingerprint')),
u AS (SELECT x.gallery, section_position, row_number() OVER (PARTITION BY x.gallery ORDER BY x.ord) AS position, {_RAW}, CASE WHEN new_ord IS NULL THEN 'added' ELSE 'matched' END AS origin, old_ord AS from_ord, work_id AS own, coalesce(q.include_in_export, x.include_in_export) AS include_in_export
  FROM works_new x JOIN places ON places.gallery = x.gallery LEFT JOIN q ON new_ord = x.ord
  UNION ALL SELECT gallery, section_position, (ord % {_PLACE})::BIGINT, {_RAW}, 'kept', NULL, work_id, include_in_export FROM stored WHERE gallery NOT IN {_G}), {_normal("u", "n")}"""
_FOUND = _WARN.removeprefix(f"WITH {_N}, w AS (").replace("SELECT work_id,", "SELECT section_position, position,", 1)
_COUNT = lambda name, test: f"'{name}=' || count(*) FILTER ({test})"
_PAIRED = "outcome IN ('cat_no', 'fingerprint')"

ORACLES = {
    "reimported_works": with_views(f"""{_STATE} SELECT n.gallery, section_position, position, cat_no, origin, '{LIST}.20250101T000000000000/' || from_ord AS from_work, include_in_export, coalesce(title_override, title) AS title, coalesce(artist_name_override, artist_name) AS artist_name,
      CASE WHEN coalesce(price_text_override, '') <> '' THEN NULL ELSE coalesce(price_numeric_override::BIGINT, price_numeric) END AS price_numeric, coalesce(price_text_override, price_text) AS price_text, coalesce(medium_override, medium) AS medium FROM n LEFT JOIN overrides o ON o.work_id = own""", "works", "works_new", "overrides"),
    "reimported_warnings": with_views(f"{_STATE}, found AS ({_FOUND} SELECT * FROM found", "works", "works_new"),
    "works_before_reimport": with_views(f"{_STATE} SELECT gallery, section_position, (ord % {_PLACE})::BIGINT AS position, cat_no, outcome, o.work_id IS NOT NULL AS overridden FROM stored LEFT JOIN plan ON old_ord = ord LEFT JOIN overrides o ON o.work_id = stored.work_id", "works", "works_new", "overrides"),
    "reimport_audit": with_views(f"""{_STATE}, b AS (SELECT outcome, o.work_id AS own FROM plan JOIN stored ON ord = old_ord LEFT JOIN overrides o ON o.work_id = stored.work_id)
      SELECT TIMESTAMP '2025-01-01' AS "at", 'reimport' AS action, 'first' AS note, 'matched=0, added=' || count(*) || ', removed=0, overrides_preserved=0, matched_by_cat_no=0, matched_by_fingerprint=0, overrides_at_risk=0' AS new_value FROM works
      UNION ALL SELECT TIMESTAMP '2025-01-02', 'override', NULL, 'overrides=' || count(*) FROM overrides
      UNION ALL SELECT TIMESTAMP '2025-01-03', 'reimport', 'second', concat_ws(', ', {_COUNT("matched", _PAIRED)}, 'added=' || (SELECT count(*) FROM u WHERE origin = 'added'), {_COUNT("removed", f"NOT {_PAIRED}")}, {_COUNT("overrides_preserved", f"{_PAIRED} AND own IS NOT NULL")},
      {_COUNT("matched_by_cat_no", "outcome = 'cat_no'")}, {_COUNT("matched_by_fingerprint", "outcome = 'fingerprint'")}, {_COUNT("overrides_at_risk", f"NOT {_PAIRED} AND own IS NOT NULL")}, 'scope=[' || '{", ".join(f"''{g}''" for g in sorted(SCOPE))}' || ']') FROM b""", "works", "works_new", "overrides"),
}
