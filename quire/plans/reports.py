"""Registered queries of the artist index, re-imports and reports, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QUALIFICATION_TOKENS, TITLE_CASE_EXCEPTIONS, IndexLayout
from ..functions import text as T
from ..operators import artists, compare, match, reimport, report, works
from ..operators.ordering import in_list_order
from ..sources.files import scratch_path
from ..sources.views import view, with_views
from .oracles import _ENTRIES, _MATCH, _WARN, _normal

_HEADINGS = IndexLayout(letter_headings=True, section_separator="2paragraph", style_digits=True)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return artists.parsed_rows(view(spark, sf, "index_source"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return artists.resolved_artists(_parsed(spark, sf), view(spark, sf, "index_rules"), view(spark, sf, "index_edits"))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "index_source").select("row_number", "courtesy", F.explode(T.catalogue_numbers(F.col("cat_nos"))).alias("cat_no"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return artists.index_entries(_resolved(spark, sf).where("include_in_export").drop("courtesy"), _numbers(spark, sf))


def index_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).select("row_number", "title", "first_name", "last_name", "quals", "company", "artist2_first_name", "artist2_last_name", "artist2_quals", "is_ra_member", "is_company", "artist2_ra_styled")


def index_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return artists.warnings(_parsed(spark, sf))


def index_messages(spark: SparkSession, sf: str) -> DataFrame:
    return artists.warning_messages(_parsed(spark, sf))


def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    return report.index_changes(_parsed(spark, sf))


def warnings_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings in the order of the works they came with."""
    rows = view(spark, sf, "works")
    rows = rows.join(rows.select("work_id", F.col("ord").alias("created_at")), "work_id")
    return report.in_time_order_of(rows, lambda own: works.warnings(works.normalise_works(own), also=("created_at",)))


def name_qualifications(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "index_source").select("row_number", T.qualification_in(F.col("raw_first_name"), F.col("raw_last_name")).alias("found"))


def index_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("row_number", "first_name", "last_name", "quals", "company", "is_company", "artist2_last_name", "index_name")


def index_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Artists with their names before and after edits, by sort key."""
    before = artists.resolved_artists(_parsed(spark, sf), view(spark, sf, "index_rules"), view(spark, sf, "index_edits").limit(0))
    after = _resolved(spark, sf).select("row_number", "index_name", "sort_key")
    out = before.select("row_number", F.col("index_name").alias("without_edits"), F.col("sort_key").alias("raw_key")).join(after, "row_number")
    return out.orderBy("sort_key", "raw_key", "row_number").select("row_number", "without_edits", "index_name")


def index_courtesy_groups(spark: SparkSession, sf: str) -> DataFrame:
    return report.courtesy_groups(_numbers(spark, sf)).withColumn("numbers", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ","))


def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    return artists.index_lines(_entries(spark, sf)).drop("sort_key", "row_number", "courtesy")


def index_lines_with_headings(spark: SparkSession, sf: str) -> DataFrame:
    return artists.index_lines(_entries(spark, sf), _HEADINGS)


def index_letter(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of one letter."""
    return _entries(spark, sf).where(artists.letter(F.col("sort_key")) == "B").select("row_number", "index_name")


def index_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with rules and edits against those without."""
    plain = _parsed(spark, sf).where("include_in_export").drop("courtesy")
    old = reimport.index_entry_keys(artists.index_entries(plain, _numbers(spark, sf)))
    return reimport.keyed_diff(old, reimport.index_entry_keys(_entries(spark, sf)), reimport.INDEX_FIELDS)


def _again(spark: SparkSession, sf: str) -> DataFrame:
    """The index rows of a later upload: some gone, some renamed, some twice."""
    rows = _parsed(spark, sf).select("row_number", "sort_key", "courtesy", F.lit(True).alias("include_in_export"))
    n = F.col("row_number")
    renamed = rows.where(n % 19 != 0).withColumn("sort_key", F.when(n % 29 == 0, F.concat("sort_key", F.lit("x"))).otherwise(F.col("sort_key")))
    return renamed.unionByName(rows.where(n % 31 == 0).withColumn("row_number", n + 1_000_000))


def index_reimport(spark: SparkSession, sf: str) -> DataFrame:
    return artists.reimport_artists(_parsed(spark, sf), _again(spark, sf)).drop("key")


def index_reimport_counts(spark: SparkSession, sf: str) -> DataFrame:
    return artists.reimport_counts(_parsed(spark, sf), _again(spark, sf), view(spark, sf, "index_edits"))


def _merged_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of artists of which every seven rows are one."""
    n = F.col("row_number")
    return _numbers(spark, sf).select((n - n % 7).alias("row_number"), F.when(n % 7 != 0, n).alias("source_row"), "cat_no")


def index_unmerged(spark: SparkSession, sf: str) -> DataFrame:
    return artists.unmerged(_merged_numbers(spark, sf)).withColumn("numbers", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ","))


def merged_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.merged_from_rows(_merged_numbers(spark, sf))


def list_stats(spark: SparkSession, sf: str) -> DataFrame:
    return report.list_stats(view(spark, sf, "listed_works"), view(spark, sf, "edited"), view(spark, sf, "imports"))


def artist_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = view(spark, sf, "index_source").select((F.col("artist_id") % 25).cast("string").alias("import_id"))
    return view(spark, sf, "imports").select("import_id").join(own.groupBy("import_id").agg(F.count("*").alias("n")), "import_id", "left").select("import_id", F.coalesce("n", F.lit(0)).alias("artists"))


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    return works.normalise_works(works.spread(view(spark, sf, "works")))


def _warnings(spark: SparkSession, sf: str) -> DataFrame:
    return works.warnings(_spread(spark, sf))


def warnings_with_works(spark: SparkSession, sf: str) -> DataFrame:
    return report.warnings_with_works(_warnings(spark, sf), view(spark, sf, "works"))


def warning_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.warning_summary(_warnings(spark, sf))


def shown_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return report.hidden(_warnings(spark, sf), "type", hide=["missing_price"], solo=["missing_price", "missing_title", "edition_anomaly"])


def warnings_with_artists(spark: SparkSession, sf: str) -> DataFrame:
    source = view(spark, sf, "index_source").where("row_number % 3 <> 0")
    messages = view(spark, sf, "works").select("work_id", F.when(F.col("ord") % 4 == 0, "No row").when(F.col("ord") % 4 == 1, F.concat(F.lit("Rows "), F.col("ord").cast("string"), F.lit(", 9: x"))).otherwise(F.concat(F.lit("Row "), F.col("ord").cast("string"), F.lit(": x"))).alias("message"))
    return report.warnings_with_artists(messages, source).select("work_id", "row", "artist_id")


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "List"), (2, "Index")], "template_id long, name string")


def audit_joined(spark: SparkSession, sf: str) -> DataFrame:
    out = report.audit_report(view(spark, sf, "audit"), view(spark, sf, "works"), view(spark, sf, "index_source").withColumn("last_name", F.col("raw_last_name")), _templates(spark), None)
    return out.select("event_id", "action", "work_id", "cat_no", "artist_id", "last_name", "template")


def audit_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the newest rows, as a page shows it (a top-k is what it is for)."""
    out = report.audit_report(view(spark, sf, "audit"), view(spark, sf, "works"), view(spark, sf, "index_source").withColumn("last_name", F.col("raw_last_name")), _templates(spark))
    return out.select("event_id", "ts", "cat_no", "last_name", "template")


def audit_by_import(spark: SparkSession, sf: str) -> DataFrame:
    return report.audit_by_import(view(spark, sf, "audit"), view(spark, sf, "imports"))


def compare_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return report.level_buckets(compare.compare_entries(works.normalise_works(view(spark, sf, "works")), view(spark, sf, "index_artists")))


def orphaned_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return report.orphans(view(spark, sf, "uploads"), view(spark, sf, "imports"))


def storage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return report.storage_stats(view(spark, sf, "uploads"))


def duplicate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return report.duplicate_names(view(spark, sf, "uploads"), view(spark, sf, "imports")).select("name")


def work_changes(spark: SparkSession, sf: str) -> DataFrame:
    return report.work_changes(_spread(spark, sf))


def title_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return report.title_reasons(_spread(spark, sf), TITLE_CASE_EXCEPTIONS)


def newest_settings(spark: SparkSession, sf: str) -> DataFrame:
    settings = view(spark, sf, "works").select((F.col("ord") % 9).cast("string").alias("kind"), (F.col("ord") % 13).alias("threshold"), F.col("ord").alias("at"))
    return report.newest_settings(settings)


def rule_export(spark: SparkSession, sf: str) -> DataFrame:
    rules = view(spark, sf, "index_rules").withColumn("rule_id", F.col("rule_id"))
    out = report.rule_export(rules, ("match_last_name", "match_first_name", "rule_id"), ("resolved_first_name", "resolved_last_name"))
    return out.select("rule_id", "json")


def template_listing(spark: SparkSession, sf: str) -> DataFrame:
    return report.template_listing(view(spark, sf, "templates"), "list")


def template_export(spark: SparkSession, sf: str) -> DataFrame:
    """Templates as files of JSON, with the kind and whether they are built in as their settings."""
    rows = view(spark, sf, "templates")
    slug = F.when(F.col("template_id") % 2 == 0, F.concat(F.lit("t"), F.col("template_id").cast("string")))
    return report.template_export(rows.select("template_id", "name", "archived", slug.alias("slug"), F.to_json(F.struct("kind", "builtin")).alias("config")))


def templates_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Templates after their files of JSON were written and read again."""
    path = scratch_path(spark, "templates")
    template_export(spark, sf).select("json", F.regexp_replace("file_name", r"\.json$", "").alias("slug")).write.partitionBy("slug").text(path)
    files = spark.read.text(path, wholetext=True).select(F.concat("slug", F.lit(".json")).alias("path"), "value")
    return report.template_import(files)


def warning_messages(spark: SparkSession, sf: str) -> DataFrame:
    return works.warning_messages(_spread(spark, sf))


def seed_actions(spark: SparkSession, sf: str) -> DataFrame:
    rules = view(spark, sf, "index_rules").select("rule_id", F.concat_ws("|", "match_first_name", "match_last_name").alias("content"))
    n = F.col("rule_id")
    seeds = rules.where(n % 7 != 0).withColumn("content", F.when(n % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).union(rules.where(n % 11 == 0).withColumn("rule_id", n + 1_000_000))
    return reimport.seeded(rules, seeds, "rule_id", "content")


def detail_tree(spark: SparkSession, sf: str) -> DataFrame:
    sections = works.section_positions(view(spark, sf, "works")).select("gallery", "section_position").distinct()
    return report.detail_tree(view(spark, sf, "works"), view(spark, sf, "overrides"), sections).drop("ord")


SCOPE = ["Brand#11", "Brand#23", "Brand#99"]


def scoped_plan(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_plan(reimport.in_scope(view(spark, sf, "works"), SCOPE), reimport.in_scope(view(spark, sf, "works_new"), SCOPE))


def applied_reimport(spark: SparkSession, sf: str) -> DataFrame:
    return reimport.apply_reimport(view(spark, sf, "works"), in_list_order(view(spark, sf, "works_new")), view(spark, sf, "overrides"), SCOPE)


def restored_list(spark: SparkSession, sf: str) -> DataFrame:
    """The newest of two snapshots of a list, put in place of a later state."""
    rows = view(spark, sf, "works").select("work_id", "raw_title")
    at = lambda day: F.lit(f"2025-01-0{day}").cast("timestamp_ntz")
    two = reimport.snapshot_rows(rows.where("work_id % 2 = 0"), "list", None, at(1)).union(reimport.snapshot_rows(rows.where("work_id % 3 = 0"), "list", None, at(2))).union(reimport.snapshot_rows(rows, "other", None, at(3)))
    return reimport.restored(rows, two, "list", at(4))[0]


def override_edits(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["work_id", "title_override", "artist_name_override", "artist_honorifics_override", "price_text_override", "medium_override"]
    return reimport.override_edits(view(spark, sf, "overrides").select(*columns), view(spark, sf, "overrides_new").select(*columns))


def _later_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Index edits of which some are gone, some moved and some are new."""
    edits, n = view(spark, sf, "index_edits"), F.col("row_number")
    kept = edits.where(n % 3 != 0).withColumn("quals_override", F.when(n % 4 == 0, "OM").otherwise(F.col("quals_override"))).withColumn("is_company_override", F.when(n % 7 == 0, False).otherwise(F.col("is_company_override")))
    return kept.union(edits.where(n % 15 == 0).withColumn("row_number", n + 1_000_000))


def index_edit_audit(spark: SparkSession, sf: str) -> DataFrame:
    return reimport.edit_audit(view(spark, sf, "index_edits"), _later_edits(spark, sf))


def index_toggle_audit(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("row_number")
    toggles = view(spark, sf, "index_source").select("row_number", F.when(n % 2 == 0, n % 4 == 0).alias("exclude"), F.when(n % 5 < 2, n % 3 == 0).alias("is_company"))
    return reimport.toggle_audit(_parsed(spark, sf), view(spark, sf, "index_edits"), toggles)


def include_toggles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("work_id")
    return reimport.include_toggles(view(spark, sf, "works"), view(spark, sf, "works").withColumn("include_in_export", (n % 17 != 0) & (n % 9 != 0)))


def effective_diff(spark: SparkSession, sf: str) -> DataFrame:
    new = view(spark, sf, "works_new").withColumn("work_id", F.col("ord"))
    sides = [works.normalise_works(x) for x in (view(spark, sf, "works"), new)]
    return match.effective_diff(sides[0], view(spark, sf, "overrides"), sides[1], view(spark, sf, "overrides_new"))


_Q = "|".join(sorted(QUALIFICATION_TOKENS, key=lambda t: (-len(t), t)))
_NULLED = lambda c: rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"
_RA = lambda c: rf"coalesce(regexp_matches({c}, '(?i)\b(RA ELECT|EX OFFICIO|HON RA|HONRA|PPRA|PRA|RA)\b'), false)"
#: Two artists in a row, for names whose qualifications stand at their end.
_PARSED = rf"""t AS (SELECT *, {", ".join(f"{_NULLED(f'raw_{c}')} AS {c}" for c in artists.TEXTS)} FROM index_source),
u AS (SELECT * EXCLUDE (first_name, last_name, quals), first_name AS f, last_name AS l, quals AS q, coalesce(regexp_matches(last_name, '(?i)^(and|&)\s+') AND first_name IS NOT NULL, false) AS two FROM t),
v AS (SELECT *, CASE WHEN two THEN trim(regexp_extract(f, '(?i)\b(({_Q})\s*)+$', 0)) END AS fq, CASE WHEN two THEN trim(regexp_replace(f, '(?i)\b(({_Q})\s*)+$', '')) END AS fn,
  CASE WHEN two THEN regexp_replace(l, '(?i)^(and|&)\s+', '') END AS l2 FROM u),
w AS (SELECT *, trim(regexp_extract(l2, '(?i)\b(({_Q})\s*)+$', 0)) AS lq, string_split(trim(regexp_replace(l2, '(?i)\b(({_Q})\s*)+$', '')), ' ') AS lw, string_split(fn, ' ') AS fw FROM v),
p AS (SELECT row_number, artist_id, raw_title, raw_first_name, raw_last_name, raw_quals, raw_company, raw_address, courtesy, include_in_export, cat_nos, title, two,
  CASE WHEN two THEN nullif(array_to_string(fw[1:len(fw) - 1], ' '), '') ELSE f END AS first_name, CASE WHEN two THEN fw[len(fw)] ELSE l END AS last_name,
  CASE WHEN two THEN nullif(concat_ws(' ', nullif(fq, ''), q), '') ELSE q END AS quals, q AS raw_q, company AS company0,
  CASE WHEN two THEN nullif(array_to_string(lw[1:len(lw) - 1], ' '), '') END AS artist2_first_name, CASE WHEN two THEN lw[len(lw)] END AS artist2_last_name, nullif(lq, '') AS artist2_quals FROM w),
parsed AS (SELECT * EXCLUDE (company0), {_RA("quals")} AS is_ra_member, first_name IS NULL AND quals IS NULL AND last_name IS NOT NULL AS is_company, {_RA("artist2_quals")} AS artist2_ra_styled,
  coalesce(company0, CASE WHEN first_name IS NULL AND quals IS NULL THEN last_name END) AS company FROM p)"""
_NUMBERS = r"list_transform(list_filter(list_transform(regexp_split_to_array(cat_nos, '[;,]'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::INT)"
_IN_NAME = lambda a, b: rf"coalesce(nullif(regexp_extract({a}, '(?i)\b({_Q})\b', 1), ''), nullif(regexp_extract({b}, '(?i)\b({_Q})\b', 1), ''))"
_MULTI = lambda c: rf"coalesce(regexp_matches({c}, '(?i)\band\b|\bwith\b|\s&\s'), false)"
_TRIMMED = lambda c: rf"coalesce(raw_{c} <> regexp_replace(raw_{c}, '^\s+|\s+$', '', 'g'), false)"
_FOREIGN = " OR ".join(rf"coalesce(regexp_matches({c}, '[^\x00-\x7F]'), false)" for c in (*artists.TEXTS, "artist2_first_name", "artist2_last_name", "artist2_quals"))
_INDEX_WARNINGS = rf"""WITH {_PARSED} SELECT row_number, unnest(list_filter([
  CASE WHEN {_TRIMMED("title")} OR {_TRIMMED("company")} OR NOT two AND ({_TRIMMED("first_name")} OR {_TRIMMED("last_name")} OR {_TRIMMED("quals")}) THEN 'whitespace_trimmed' END, CASE WHEN two THEN 'multi_artist_name_changed' END,
  CASE WHEN two AND quals IS DISTINCT FROM raw_q THEN 'quals_extracted' END, CASE WHEN is_ra_member THEN 'ra_member_detected' END, CASE WHEN coalesce(len({_NUMBERS}), 0) = 0 THEN 'missing_cat_nos' END,
  CASE WHEN is_company THEN 'possible_company' END, CASE WHEN {_MULTI("first_name")} OR {_MULTI("last_name")} THEN 'multi_artist_name_suspected' END,
  CASE WHEN artist2_last_name IS NOT NULL AND is_ra_member AND NOT artist2_ra_styled THEN 'ra_styling_ambiguous' END, CASE WHEN coalesce({_IN_NAME("first_name", "last_name")}, {_IN_NAME("artist2_first_name", "artist2_last_name")}) IS NOT NULL THEN 'quals_in_name_field' END,
  CASE WHEN {_FOREIGN} THEN 'non_ascii_characters' END], lambda x: x IS NOT NULL)) AS type FROM parsed"""
_LABELS = (("title", "Title"), ("last_name", "Last Name"), ("first_name", "First Name"), ("quals", "Quals"), ("company", "Company"))
_LAYER = lambda f: f"CASE WHEN {f}_override IS NOT NULL THEN nullif({f}_override, '')"
_RESOLVED = f"""WITH {_PARSED}, k AS (SELECT * FROM index_rules QUALIFY row_number() OVER (PARTITION BY match_first_name, match_last_name, match_quals ORDER BY is_seeded, rule_id) = 1),
r AS (SELECT p.*, CASE WHEN x.rule_id IS NOT NULL THEN x ELSE w END AS k, o.* EXCLUDE (row_number) FROM parsed p LEFT JOIN k x ON x.match_quals <> '' AND x.match_first_name = coalesce(first_name, '') AND x.match_last_name = coalesce(last_name, '') AND x.match_quals = coalesce(quals, '')
  LEFT JOIN k w ON w.match_quals = '' AND w.match_first_name = coalesce(first_name, '') AND w.match_last_name = coalesce(last_name, '') LEFT JOIN index_edits o ON o.row_number = p.row_number),
q AS (SELECT row_number, title, {_LAYER("first_name")} WHEN k.resolved_first_name IS NOT NULL THEN nullif(k.resolved_first_name, '') ELSE first_name END AS first_name, coalesce(k.resolved_last_name, last_name) AS last_name, {_LAYER("quals")} ELSE quals END AS quals,
  coalesce(is_company_override, k.resolved_is_company, is_company) AS is_company, company AS c0, company_override, raw_company, artist2_first_name AS a2f, coalesce(k.resolved_artist2_last_name, artist2_last_name) AS a2l, artist2_quals AS a2q, coalesce(artist2_shared_surname_override, false) AS shared, include_in_export, courtesy, cat_nos, is_ra_member, artist2_ra_styled FROM r),
z AS (SELECT * EXCLUDE (a2f, a2l, a2q), CASE WHEN NOT is_company THEN a2f END AS a2f, CASE WHEN NOT is_company THEN a2l END AS a2l, CASE WHEN NOT is_company THEN a2q END AS a2q, CASE WHEN is_company AND company_override IS NULL AND coalesce(trim(raw_company), '') = '' THEN last_name ELSE coalesce(company_override, c0) END AS company FROM q),
resolved AS (SELECT *, CASE WHEN coalesce(last_name, first_name) IS NULL THEN '' ELSE concat_ws(' ', concat_ws(', ', coalesce(last_name, first_name), CASE WHEN NOT is_company AND last_name IS NOT NULL AND first_name IS NOT NULL THEN concat_ws(' ', title, first_name) END), quals)
  || coalesce(CASE WHEN shared THEN ' and ' ELSE ', and ' END || nullif(concat_ws(' ', a2f, CASE WHEN NOT shared THEN a2l END), '') || coalesce(' ' || a2q, ''), '') END AS index_name FROM z)"""
_IV = ("index_source", "index_rules", "index_edits")
_ES = lambda c: rf"replace(replace(replace({c}, '\', '\\'), '<', '\<'), '>', '\>')"
_STYLE = lambda style, c: f"'<cstyle:{style}>' || {c} || '<cstyle:>'"
_RANKED = lambda member, c: f"' ' || CASE WHEN {member} THEN {_STYLE('RA Caps', f'lower({_ES(c)})')} ELSE {_STYLE('Small caps', f'lower({_ES(c)})')} END"
_INDEX_LINES = rf"""{_RESOLVED}, e AS (SELECT *, coalesce({_ES("last_name")}, {_ES("first_name")}, {_ES("company")}, '') AS sur, strip_accents(lower(CASE WHEN last_name IS NULL THEN coalesce(first_name, '') ELSE trim(last_name || ' ' || coalesce(first_name, '')) END)) AS sk
  FROM resolved WHERE include_in_export AND len({_NUMBERS}) > 0),
g AS (SELECT *, CASE WHEN sk = '' THEN '?' WHEN regexp_matches(sk, '^[0-9]') THEN '#' ELSE upper(left(sk, 1)) END AS letter, CASE WHEN a2f IS NOT NULL OR a2l IS NOT NULL THEN 'and ' || CASE WHEN shared THEN coalesce({_ES("a2f")}, '') ELSE coalesce({_ES("a2f")} || ' ', '') || coalesce(CASE WHEN artist2_ra_styled THEN {_STYLE("RA Member Cap Surname", _ES("a2l"))} ELSE {_ES("a2l")} END, '') END
  || coalesce({_RANKED("artist2_ra_styled", "a2q")}, '') || ', ' ELSE '' END AS second FROM e),
li AS (SELECT letter, sk, '<pstyle:Index Text>' || CASE WHEN is_ra_member THEN {_STYLE("RA Member Cap Surname", "sur")} ELSE sur END || CASE WHEN last_name IS NOT NULL AND first_name IS NOT NULL THEN ', ' || concat_ws(' ', {_ES("title")}, {_ES("first_name")}) ELSE '' END || coalesce({_RANKED("is_ra_member", "quals")}, '')
  || CASE WHEN second <> '' AND shared THEN ' ' ELSE ', ' END || second || coalesce(coalesce({_ES("courtesy")}, CASE WHEN NOT is_company THEN {_ES("company")} END) || ', ', '') || array_to_string(list_transform(list_sort({_NUMBERS}), lambda n: {_STYLE("Index works numbers", "n::VARCHAR")}), ', ') AS line FROM g)"""
_AGAIN = f"""WITH {_PARSED}, o AS (SELECT row_number, strip_accents(lower(CASE WHEN last_name IS NULL THEN coalesce(first_name, '') ELSE trim(last_name || ' ' || coalesce(first_name, '')) END)) AS s, coalesce(courtesy, '') AS c, include_in_export FROM parsed),
n AS (SELECT row_number, CASE WHEN row_number % 29 = 0 THEN s || 'x' ELSE s END AS s, c FROM o WHERE row_number % 19 <> 0 UNION ALL SELECT row_number + 1000000, s, c FROM o WHERE row_number % 31 = 0),
k AS (SELECT s || '|' || c AS key, arg_max(include_in_export, row_number) AS inc, max(row_number) AS old_row FROM o GROUP BY 1), f AS (SELECT s || '|' || c AS key, min(row_number) AS first FROM n GROUP BY 1),
plan AS (SELECT n.row_number, f.key, k.key IS NOT NULL AND n.row_number = f.first AS m, k.inc, k.old_row FROM n JOIN f ON f.key = n.s || '|' || n.c LEFT JOIN k ON k.key = f.key)"""
_MERGED = f"m AS (SELECT row_number - row_number % 7 AS row_number, CASE WHEN row_number % 7 <> 0 THEN row_number END AS source_row, unnest({_NUMBERS}) AS cat_no FROM index_source)"
_N = _normal("works", "n")
_REASONS = rf"""CASE WHEN coalesce(raw_title <> trim(raw_title), false) THEN 'title trimmed' END, CASE WHEN trim(raw_title) IS DISTINCT FROM title THEN 'title substituted' END, CASE WHEN coalesce(raw_artist <> trim(raw_artist), false) THEN 'artist trimmed' END,
  CASE WHEN artist_honorifics IS NOT NULL THEN 'honorifics extracted' END, CASE WHEN coalesce(raw_medium <> trim(raw_medium), false) THEN 'medium trimmed' END, CASE WHEN coalesce(regexp_matches(raw_edition, '^Edition of [0-9]'), false) AND edition_total IS NULL THEN 'edition suppressed' END"""
_EDITS = ("title", "artist_name", "artist_honorifics", "price_text", "medium")
_INDEX_EDITS = ("first_name_override", "quals_override", "is_company_override", "artist2_shared_surname_override", "company_override")
_SAID = lambda c: f"CASE ({c})::VARCHAR WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE ({c})::VARCHAR END"
_SCOPED = _MATCH.replace("FROM works)", f"FROM works WHERE gallery IN ({', '.join(repr(g) for g in SCOPE)}))").replace("FROM works_new)", f"FROM works_new WHERE gallery IN ({', '.join(repr(g) for g in SCOPE)}))")
_G = f"({', '.join(repr(g) for g in SCOPE)})"

QUERIES = {f.__name__: f for f in (
    index_parsed, index_warnings, index_messages, index_changes, warnings_in_order, name_qualifications, index_resolved, index_listing, index_courtesy_groups, index_lines, index_lines_with_headings, index_letter, index_diff, index_reimport,
    index_reimport_counts, index_unmerged, merged_from_rows, list_stats, artist_counts, warnings_with_works, warning_summary, shown_warnings, warnings_with_artists, audit_joined, audit_newest,
    audit_by_import, compare_buckets, orphaned_uploads, storage_stats, duplicate_uploads, work_changes, title_reasons, newest_settings, rule_export, template_listing, template_export, warning_messages, seed_actions, detail_tree, scoped_plan,
    applied_reimport, restored_list, override_edits, include_toggles, effective_diff, index_edit_audit, index_toggle_audit, templates_read_back,
)}

_SECTION = "SELECT gallery, row_number() OVER (ORDER BY min(ord))::INT AS section_position FROM works GROUP BY gallery"
ORACLES = {
    "index_parsed": with_views(f"WITH {_PARSED} SELECT row_number, title, first_name, last_name, quals, company, artist2_first_name, artist2_last_name, artist2_quals, is_ra_member, is_company, artist2_ra_styled FROM parsed", "index_source"),
    "index_warnings": with_views(_INDEX_WARNINGS, "index_source"),
    "index_messages": with_views(f"""{_INDEX_WARNINGS.replace("SELECT row_number, unnest(", "SELECT *, unnest(", 1).replace(f"WITH {_PARSED} ", f"WITH {_PARSED}, y AS (", 1)}), z AS (SELECT *, concat_ws(', ', last_name, first_name) AS name, concat_ws(' ', artist2_first_name, artist2_last_name) AS other FROM y)
      SELECT row_number, type, CASE type WHEN 'whitespace_trimmed' THEN 'White space trimmed from ' || concat_ws(', ', {", ".join(f"CASE WHEN {_TRIMMED(c)} THEN '{c}' END" for c in artists.TEXTS)}) WHEN 'multi_artist_name_changed' THEN 'Two artists in a row: ' || name || ' and ' || other
      WHEN 'quals_extracted' THEN 'Qualifications taken from the name: ' || quals WHEN 'ra_member_detected' THEN 'A member by qualifications: ' || quals WHEN 'missing_cat_nos' THEN 'No catalogue numbers for ' || name WHEN 'possible_company' THEN 'Perhaps a company: ' || last_name
      WHEN 'multi_artist_name_suspected' THEN 'Perhaps several artists: ' || name WHEN 'ra_styling_ambiguous' THEN 'A member with another artist: ' || name || ' and ' || other WHEN 'quals_in_name_field' THEN 'Qualifications in the name ' || name ELSE 'Characters beyond ASCII in ' || name END AS message FROM z""", "index_source"),
    "index_changes": with_views(f"""WITH {_PARSED} SELECT row_number, concat_ws('; ', 'Whitespace trimmed: ' || nullif(concat_ws(', ', {", ".join(f"CASE WHEN coalesce(raw_{c}, '') <> coalesce({c}, '') AND trim(coalesce(raw_{c}, '')) = trim(coalesce({c}, '')) THEN '{label}' END" for c, label in _LABELS)}), ''),
      'Values changed: ' || nullif(concat_ws(', ', {", ".join(f"CASE WHEN trim(coalesce(raw_{c}, '')) <> trim(coalesce({c}, '')) THEN '{label}' END" for c, label in _LABELS)}), ''), CASE WHEN is_company THEN 'Auto-detected as company (no first name)' END,
      CASE WHEN artist2_last_name IS NOT NULL AND regexp_matches(lower(trim(raw_last_name)), '^(and|&) ') THEN 'Multi-artist entry parsed (second artist extracted from Last Name)' END) AS reasons FROM parsed""", "index_source"),
    "name_qualifications": with_views(f"SELECT row_number, {_IN_NAME('raw_first_name', 'raw_last_name')} AS found FROM index_source", "index_source"),
    "index_resolved": with_views(f"{_RESOLVED} SELECT row_number, first_name, last_name, quals, company, is_company, a2l AS artist2_last_name, index_name FROM resolved", *_IV),
    "index_courtesy_groups": with_views(f"SELECT row_number, courtesy, array_to_string(list_sort({_NUMBERS}), ',') AS numbers FROM index_source WHERE len({_NUMBERS}) > 0", "index_source"),
    "index_letter": with_views(f"{_RESOLVED} SELECT row_number, index_name FROM resolved WHERE include_in_export AND len({_NUMBERS}) > 0 AND upper(left(strip_accents(lower(coalesce(last_name, first_name))), 1)) = 'B'", *_IV),
    "index_lines": with_views(f"{_INDEX_LINES} SELECT letter, 1::BIGINT AS place, line FROM li UNION ALL SELECT letter, -1::BIGINT, '' FROM (SELECT letter, min(sk) AS m FROM li GROUP BY letter) WHERE (m, letter) <> (SELECT min((sk, letter)) FROM li) UNION ALL SELECT NULL, 0::BIGINT, '<ASCII-MAC>'", *_IV),
    "index_reimport": with_views(f"{_AGAIN} SELECT row_number, CASE WHEN m THEN 'matched' ELSE 'added' END AS outcome, CASE WHEN m THEN inc ELSE true END AS include_in_export, CASE WHEN m THEN old_row END AS old_row FROM plan", "index_source"),
    "index_reimport_counts": with_views(f"{_AGAIN} SELECT count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS added, (SELECT count(*) FROM k WHERE key NOT IN (SELECT key FROM plan WHERE m)) AS removed, count(*) FILTER (m AND old_row IN (SELECT row_number FROM index_edits)) AS overrides_preserved FROM plan", "index_source", "index_edits"),
    "index_unmerged": with_views(f"WITH {_MERGED}, p AS (SELECT row_number, coalesce(source_row, row_number) AS source_row, array_to_string(list(cat_no ORDER BY cat_no), ',') AS numbers FROM m GROUP BY 1, 2) SELECT row_number, source_row, numbers, source_row = arg_min(source_row, (source_row <> row_number, source_row)) OVER (PARTITION BY row_number) AS keeps FROM p QUALIFY count(*) OVER (PARTITION BY row_number) > 1", "index_source"),
    "merged_from_rows": with_views(f"WITH {_MERGED} SELECT row_number, CASE WHEN count(DISTINCT source_row) > 1 THEN array_to_string(list(DISTINCT source_row ORDER BY source_row), ',') END AS merged_from FROM m GROUP BY row_number", "index_source"),
    "list_stats": with_views("WITH w AS (SELECT import_id, count(DISTINCT gallery) AS sections, count(*) AS works FROM listed_works GROUP BY 1), o AS (SELECT import_id, count(*) AS overrides, max(updated_at) AS newest_override FROM listed_works JOIN edited USING (work_id) GROUP BY 1) SELECT i.import_id, uploaded_at, coalesce(sections, 0) AS sections, coalesce(works, 0) AS works, coalesce(overrides, 0) AS overrides, newest_override FROM imports i LEFT JOIN w ON w.import_id = i.import_id LEFT JOIN o ON o.import_id = i.import_id", "listed_works", "edited", "imports"),
    "artist_counts": with_views("SELECT i.import_id, count(s.artist_id) AS artists FROM imports i LEFT JOIN index_source s ON (s.artist_id % 25)::VARCHAR = i.import_id GROUP BY 1", "imports", "index_source"),
    "warnings_with_works": with_views(f"{_WARN} SELECT w.work_id, w.type, cat_no, gallery FROM w LEFT JOIN works ON works.work_id = w.work_id", "works"),
    "warning_summary": with_views(f"{_WARN} SELECT type, type IN {report.SEVERE} AS severe, count(*) AS n FROM w GROUP BY type", "works"),
    "warnings_in_order": with_views(f"{_WARN} SELECT ord AS created_at, w.work_id, w.type FROM w JOIN works ON works.work_id = w.work_id", "works"),
    "shown_warnings": with_views(f"{_WARN} SELECT * FROM w WHERE type IN ('missing_title', 'edition_anomaly')", "works"),
    "warnings_with_artists": with_views("SELECT work_id, CASE WHEN ord % 4 <> 0 THEN ord END AS row, artist_id FROM works LEFT JOIN (SELECT * FROM index_source WHERE row_number % 3 <> 0) a ON a.row_number = CASE WHEN ord % 4 <> 0 THEN ord END", "works", "index_source"),
    "audit_joined": with_views("SELECT event_id, action, a.work_id, cat_no, a.artist_id, raw_last_name AS last_name, CASE template_id WHEN 1 THEN 'List' WHEN 2 THEN 'Index' END AS template FROM audit a LEFT JOIN works w ON w.work_id = a.work_id LEFT JOIN index_source s ON s.artist_id = a.artist_id", "audit", "works", "index_source"),
    "audit_newest": with_views("SELECT event_id, ts, cat_no, raw_last_name AS last_name, CASE template_id WHEN 1 THEN 'List' WHEN 2 THEN 'Index' END AS template FROM (SELECT * FROM audit ORDER BY ts DESC, event_id DESC LIMIT 200) a LEFT JOIN works w ON w.work_id = a.work_id LEFT JOIN index_source s ON s.artist_id = a.artist_id", "audit", "works", "index_source"),
    "audit_by_import": with_views("SELECT a.import_id, name, count(*) AS events, count(DISTINCT user_id) AS users, max(ts) AS newest FROM audit a LEFT JOIN imports i ON i.import_id = a.import_id GROUP BY ALL", "audit", "imports"),
    "compare_buckets": with_views(f"{_ENTRIES} SELECT CASE WHEN differences LIKE 'missing_in%' THEN 'missing' WHEN level IN ('exact', 'equivalent') THEN 'match' WHEN level LIKE 'partial_%' THEN substr(level, 9) ELSE 'none' END AS bucket, count(*) AS n FROM entries GROUP BY 1", "works", "index_artists"),
    "orphaned_uploads": with_views("SELECT * FROM uploads WHERE path NOT IN (SELECT stored_as FROM imports)", "uploads", "imports"),
    "storage_stats": with_views("SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM uploads", "uploads"),
    "duplicate_uploads": with_views("SELECT name FROM uploads WHERE name IN (SELECT name FROM imports)", "uploads", "imports"),
    "work_changes": with_views(f"WITH {_N} SELECT work_id, array_to_string(list_filter([{_REASONS}], lambda x: x IS NOT NULL), '; ') AS reasons FROM n", "works"),
    "title_reasons": with_views(rf"WITH {_N}, w AS (SELECT DISTINCT work_id, upper(regexp_replace(t, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g')) AS token FROM (SELECT work_id, unnest(regexp_split_to_array(title, '\s+')) AS t FROM n)), r AS (SELECT *, CASE WHEN token IN ({', '.join(repr(x.upper()) for x in TITLE_CASE_EXCEPTIONS)}) THEN 'exception' WHEN len(token) > 1 AND token NOT IN ('MIX', 'DI', 'LI', 'MM', 'CD', 'MI', 'DC') AND regexp_full_match(token, 'M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})') THEN 'roman' END AS reason FROM w) SELECT * FROM r WHERE reason IS NOT NULL", "works"),
    "newest_settings": with_views("SELECT (ord % 9)::VARCHAR AS kind, arg_max(ord % 13, ord) AS threshold, max(ord) AS \"at\" FROM works WHERE ord % 13 <= 10 GROUP BY 1", "works"),
    "rule_export": with_views("""SELECT rule_id, '{"match_last_name":"' || match_last_name || '","match_first_name":"' || match_first_name || '","rule_id":' || rule_id || coalesce(',"resolved_first_name":"' || resolved_first_name || '"', '') || coalesce(',"resolved_last_name":"' || resolved_last_name || '"', '') || '}' AS json FROM index_rules""", "index_rules"),
    "template_listing": with_views("SELECT template_id, name, builtin FROM templates WHERE kind = 'list' AND NOT archived", "templates"),
    "template_export": with_views("""SELECT template_id, CASE WHEN template_id % 2 = 0 THEN 't' || template_id ELSE trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') END || '.json' AS file_name,
      '{"_name":"' || name || '","kind":"' || kind || '","builtin":' || builtin || '}' AS json FROM templates WHERE NOT archived""", "templates"),
    "warning_messages": with_views(rf"""{_WARN} SELECT work_id, type, CASE type WHEN 'unrecognised_price' THEN concat('The price ', chr(39), raw_price, chr(39), ' can', chr(39), 't be read') WHEN 'edition_anomaly' THEN concat('The edition ', chr(39), raw_edition, chr(39), ' can', chr(39), 't be read')
      WHEN 'missing_title' THEN 'The work has no title' WHEN 'missing_artist' THEN 'The work has no artist' WHEN 'missing_price' THEN 'The work has no price' WHEN 'zero_edition_suppressed' THEN concat('The edition ', chr(39), raw_edition, chr(39), ' is of none and left out')
      WHEN 'whitespace_trimmed' THEN 'White space trimmed from ' || concat_ws(', ', {", ".join(rf"CASE WHEN raw_{f} <> regexp_replace(raw_{f}, '^\s+|\s+$', '', 'g') THEN '{f}' END" for f in ("title", "artist", "medium"))})
      WHEN 'title_case_roman' THEN concat('Roman numerals in ', chr(39), title, chr(39), ' keep their case') WHEN 'title_case_exception' THEN concat('Exceptions in ', chr(39), title, chr(39), ' keep their case')
      ELSE 'Characters beyond ASCII in title: … (U+2026)' END AS message FROM w JOIN n USING (work_id)""", "works"),
    "seed_actions": with_views("SELECT rule_id, CASE WHEN rule_id % 7 = 0 THEN 'delete' WHEN rule_id % 5 = 0 THEN 'update' ELSE 'keep' END AS action FROM index_rules UNION ALL SELECT rule_id + 1000000, 'insert' FROM index_rules WHERE rule_id % 11 = 0", "index_rules"),
    "detail_tree": with_views(f"WITH s AS ({_SECTION}) SELECT s.gallery, section_position, w.work_id, cat_no, CASE WHEN o.work_id IS NOT NULL THEN concat_ws(',', {', '.join(f'''CASE WHEN {c}_override IS NOT NULL THEN '{c}' END''' for c in ('title', 'artist_name', 'artist_honorifics', 'price_numeric', 'price_text', 'edition_total', 'medium'))}) END AS overridden FROM s JOIN works w ON w.gallery = s.gallery LEFT JOIN overrides o ON o.work_id = w.work_id", "works", "overrides"),
    "scoped_plan": with_views(f"{_SCOPED} SELECT * FROM plan", "works", "works_new"),
    "applied_reimport": with_views(f"""{_SCOPED}, s AS ({_SECTION}), g AS (SELECT gallery, min(ord) AS first FROM works_new WHERE gallery IN {_G} GROUP BY 1), places AS (SELECT g.gallery, coalesce(s.section_position, (SELECT max(section_position) FROM s) + sum(CASE WHEN s.gallery IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY first))::INT AS section_position FROM g LEFT JOIN s ON s.gallery = g.gallery),
      q AS (SELECT new_ord, w.work_id, w.include_in_export, o.work_id AS own FROM plan JOIN works w ON w.ord = old_ord LEFT JOIN overrides o ON o.work_id = w.work_id WHERE outcome IN ('cat_no', 'fingerprint'))
      SELECT n.ord, n.gallery, section_position, CASE WHEN new_ord IS NULL THEN 'added' ELSE 'matched' END AS origin, own AS old_work, coalesce(q.include_in_export, n.include_in_export) AS include_in_export, row_number() OVER (PARTITION BY n.gallery ORDER BY n.ord) AS position FROM works_new n JOIN places ON places.gallery = n.gallery LEFT JOIN q ON new_ord = n.ord
      UNION ALL SELECT ord, w.gallery, section_position, 'kept', o.work_id, include_in_export, row_number() OVER (PARTITION BY w.gallery ORDER BY ord) FROM works w JOIN s ON s.gallery = w.gallery LEFT JOIN overrides o ON o.work_id = w.work_id WHERE w.gallery NOT IN {_G}""", "works", "works_new", "overrides"),
    "restored_list": with_views("SELECT work_id, raw_title FROM works WHERE work_id % 3 = 0", "works"),
    "override_edits": with_views(" UNION ALL ".join(f"SELECT coalesce(a.work_id, b.work_id) AS work_id, CASE WHEN b.work_id IS NULL THEN 'override_deleted' ELSE 'override_set' END AS action, '{f}_override' AS field, a.{f}_override AS old_value, b.{f}_override AS new_value FROM overrides a FULL JOIN overrides_new b ON a.work_id = b.work_id WHERE a.{f}_override IS DISTINCT FROM b.{f}_override" for f in _EDITS), "overrides", "overrides_new"),
    "index_edit_audit": with_views(f"""WITH b AS (SELECT * REPLACE (CASE WHEN row_number % 4 = 0 THEN 'OM' ELSE quals_override END AS quals_override, CASE WHEN row_number % 7 = 0 THEN false ELSE is_company_override END AS is_company_override) FROM index_edits WHERE row_number % 3 <> 0
      UNION ALL SELECT * REPLACE (row_number + 1000000 AS row_number) FROM index_edits WHERE row_number % 15 = 0) SELECT row_number, 'override_deleted' AS action, NULL::VARCHAR AS field, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM index_edits WHERE row_number % 3 = 0 UNION ALL
      {" UNION ALL ".join(f"SELECT b.row_number, 'override_set', '{f}', {_SAID(f'a.{f}')}, {_SAID(f'b.{f}')} FROM b LEFT JOIN index_edits a ON a.row_number = b.row_number WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _INDEX_EDITS)}""", "index_edits"),
    "index_toggle_audit": with_views(f"""WITH {_PARSED}, asked AS (SELECT p.row_number, include_in_export AS shown, coalesce(is_company_override, is_company) AS company, p.row_number % 4 = 0 AS exclude, p.row_number % 3 = 0 AS wanted FROM parsed p LEFT JOIN index_edits e ON e.row_number = p.row_number)
      SELECT row_number, CASE WHEN exclude THEN 'index_artist_excluded' ELSE 'index_artist_included' END AS action, 'include_in_export' AS field, {_SAID("shown")} AS old_value, {_SAID("NOT exclude")} AS new_value FROM asked WHERE row_number % 2 = 0 AND exclude = shown
      UNION ALL SELECT row_number, CASE WHEN wanted THEN 'index_artist_company_set' ELSE 'index_artist_company_unset' END, 'is_company_override', {_SAID("company")}, {_SAID("wanted")} FROM asked WHERE row_number % 5 < 2 AND wanted <> company""", "index_source", "index_edits"),
    "templates_read_back": with_views("""SELECT CASE WHEN template_id % 2 = 0 THEN 't' || template_id ELSE trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug, name, '{"kind":"' || kind || '","builtin":' || builtin || '}' AS config FROM templates WHERE NOT archived""", "templates"),
    "include_toggles": with_views("SELECT work_id, 'excluded' AS action FROM works WHERE include_in_export AND work_id % 9 = 0", "works"),
}
