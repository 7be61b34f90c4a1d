"""Registered queries of the catalogue operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as N
from ..operators import artists, compare, index, match, tags, works
from ..operators.ordering import in_list_order
from ..sources.views import view
from ..streaming import audit
from . import exports, lists, oracles, reports, stores

Query = Callable[[SparkSession, str], DataFrame]


def _normalised(spark: SparkSession, sf: str, name: str = "works") -> DataFrame:
    return works.normalise_works(view(spark, sf, name))


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    return works.normalise_works(works.spread(view(spark, sf, "works")))


def normalise_works(spark: SparkSession, sf: str) -> DataFrame:
    out = _spread(spark, sf)
    return out.select("work_id", "title", "artist_name", "artist_honorifics", F.col("price_numeric").cast("long").alias("price_numeric"), "price_text", "edition_total", F.col("edition_price").cast("long").alias("edition_price"))


def all_work_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return works.warnings(_spread(spark, sf))


def all_warning_counts(spark: SparkSession, sf: str) -> DataFrame:
    return all_work_warnings(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


def work_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return all_work_warnings(spark, sf)


def warning_counts(spark: SparkSession, sf: str) -> DataFrame:
    return work_warnings(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    return works.effective_works(_spread(spark, sf), view(spark, sf, "overrides"))


def effective_works(spark: SparkSession, sf: str) -> DataFrame:
    return works.export_rows(_effective(spark, sf)).drop("ord")


def section_positions(spark: SparkSession, sf: str) -> DataFrame:
    return works.section_positions(view(spark, sf, "works"))


def gallery_summary(spark: SparkSession, sf: str) -> DataFrame:
    return works.gallery_summary(view(spark, sf, "works"))


def override_stats(spark: SparkSession, sf: str) -> DataFrame:
    return works.override_stats(view(spark, sf, "works"), view(spark, sf, "overrides"))


def without_override(spark: SparkSession, sf: str) -> DataFrame:
    return works.without_override(view(spark, sf, "works"), view(spark, sf, "overrides"))


def search_works(spark: SparkSession, sf: str) -> DataFrame:
    return works.search(view(spark, sf, "works"), " 77 ")


def match_plan(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_plan(view(spark, sf, "works"), view(spark, sf, "works_new"))


def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return match_plan(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


def cross_gallery_moves(spark: SparkSession, sf: str) -> DataFrame:
    return match.cross_gallery_moves(view(spark, sf, "works"), view(spark, sf, "works_new"))


def state_diff(spark: SparkSession, sf: str) -> DataFrame:
    return match.state_diff(_normalised(spark, sf), _normalised(spark, sf, "works_new"))


def state_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state_diff(spark, sf).groupBy("field", "cause").agg(F.count("*").alias("n"))


def export_diff(spark: SparkSession, sf: str) -> DataFrame:
    return match.snapshot_diff(_normalised(spark, sf), works.normalise_works(in_list_order(view(spark, sf, "works_new"))), ("title", "artist_name", "artist_honorifics", "price_text", "edition_total", "medium", "gallery"))


def section_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return match.section_alignment(view(spark, sf, "works"), in_list_order(view(spark, sf, "works_new")))


def compare_entries(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_entries(_normalised(spark, sf), view(spark, sf, "index_artists"))


def compare_summary(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_summary(compare_entries(spark, sf))


def name_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison of names on made-up pairs: every artist with a variant of its own name."""
    a = view(spark, sf, "index_artists")
    n = F.col("artist_id")
    name = F.when(n % 4 == 0, F.concat_ws(" ", "first_name", "last_name")).when(n % 4 == 1, F.concat(F.lit("Other "), F.col("last_name"))).when(n % 4 == 2, F.concat_ws(" ", "title", "first_name", "last_name")).otherwise(F.concat_ws(" ", "last_name", "first_name"))
    pairs = a.select("artist_id", name.alias("name"), F.when(n % 3 == 0, "RA").when(n % 3 == 1, "OBE RA").alias("honorifics"), "title", F.col("first_name").alias("first"), F.col("last_name").alias("last"), "quals", F.lit(False).alias("is_company"))
    return compare.compare_names(pairs).select("artist_id", "level", F.array_join("differences", "; ").alias("differences"))


def effective_artists(spark: SparkSession, sf: str) -> DataFrame:
    return index.effective_artists(view(spark, sf, "index_artists"), view(spark, sf, "known_artists"))


def index_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "index_artists")
    return rows.select("artist_id", index.index_name(rows).alias("index_name"))


def artist_flags(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    names = (c("first_name"), c("last_name"))
    return view(spark, sf, "index_artists").select("artist_id", T.is_member(c("quals")).alias("is_member"), T.is_company_name(*names, c("quals")).alias("is_company"), T.is_multi_name(*names).alias("is_multi"), F.array_join(F.transform(T.catalogue_numbers(c("cat_nos")), lambda x: x.cast("string")), ",").alias("numbers"))


def merged_artists(spark: SparkSession, sf: str) -> DataFrame:
    return index.merged_artists(view(spark, sf, "index_artists"))


def _namesakes(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows whose names have lost their numbers, so that many are alike."""
    plain = {c: F.regexp_replace(c, "[0-9]+$", "") for c in ("first_name", "last_name")}
    return view(spark, sf, "index_artists").withColumns(plain)


def merged_index_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return artists.merged_row_warnings(_namesakes(spark, sf))


def merged_number_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of merged artists in chunks of three."""
    return index.merged_numbers(_namesakes(spark, sf), 3)


def letter_groups(spark: SparkSession, sf: str) -> DataFrame:
    return index.letter_groups(view(spark, sf, "index_artists"))


def linked_entries(spark: SparkSession, sf: str) -> DataFrame:
    return index.linked_entries(view(spark, sf, "index_artists"))


def tag_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return tags.parse_entries(tags.render_entries(works.export_rows(_effective(spark, sf))))


def audit_latest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.latest_by_key(spark.read.parquet(f"{sf}/events.parquet"))


def audit_windows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.actions_by_window(spark.read.parquet(f"{sf}/events.parquet")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def artist_sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "index_artists")
    return rows.select("artist_id", N.sort_key(index.sort_name(rows)).alias("sort_key"))


def document_sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The sort keys of whole texts."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", N.sort_key("text").alias("sort_key"))


def sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    return document_sort_keys(spark, sf)


def title_cased(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(spark, sf).select("work_id", N.title_case("title").alias("title_cased"))


def mac_roman_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(spark, sf).select("work_id", N.mac_roman("title").alias("encoded"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        effective_works, normalise_works, all_work_warnings, all_warning_counts, work_warnings, warning_counts, section_positions, gallery_summary, override_stats, without_override, search_works,
        match_plan, match_counts, cross_gallery_moves, state_diff, state_diff_counts, export_diff, section_alignment, compare_entries, compare_summary,
        name_comparison, effective_artists, index_names, artist_flags, merged_artists, merged_index_warnings, merged_number_chunks, letter_groups, linked_entries, tag_round_trip, audit_latest,
        audit_windows, artist_sort_keys, document_sort_keys, sort_keys, title_cased, mac_roman_titles,
    )
} | exports.QUERIES | reports.QUERIES | stores.QUERIES | lists.QUERIES

ORACLES = oracles.ORACLES | exports.ORACLES | reports.ORACLES | stores.ORACLES | lists.ORACLES
