"""DuckDB SQL for the queries of ``plans.queries``."""

from __future__ import annotations

from ..config import ROMAN, ROMAN_EXCLUDED, TITLE_CASE_EXCEPTIONS
from ..sources.views import with_views

_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_TOKENS = "'RA','PRA','PPRA','HON','HONRA','ELECT','EX','OFFICIO'"


def _normal(source: str, name: str) -> str:
    """Common table ``name``: the normalised rows of ``source``."""
    return rf"""{name}_1 AS (
  SELECT *, {_TRIM("raw_artist")} AS ra, list_filter(regexp_split_to_array({_TRIM("raw_artist")}, '\s+'), lambda x: x <> '') AS ws, {_TRIM("coalesce(raw_price, '')")} AS rp FROM {source}
), {name}_2 AS (
  SELECT *, coalesce(nullif(coalesce(list_position(list_transform(list_reverse(ws), lambda x: upper(x) NOT IN ({_TOKENS})), true), 0), 0) - 1, len(ws)) AS tail,
    CASE WHEN upper(rp) NOT IN ('', '*', 'NFS') THEN trunc(TRY_CAST(nullif(regexp_replace(rp, '[^0-9.]', '', 'g'), '') AS DECIMAL(38,9)))::BIGINT END AS pn,
    TRY_CAST(nullif(regexp_extract(raw_edition, '^Edition of ([0-9]+)', 1), '') AS INT) AS et,
    trunc(TRY_CAST(nullif(replace(regexp_extract(raw_edition, '^Edition of [0-9]+ at .*?([0-9,]+\.?[0-9]*)', 1), ',', ''), '') AS DECIMAL(38,9)))::BIGINT AS ep
  FROM {name}_1
), {name} AS (
  SELECT * EXCLUDE (ra, ws, rp, tail, pn, et, ep), replace({_TRIM("raw_title")}, '...', '…') AS title, replace({_TRIM("raw_medium")}, '...', '…') AS medium,
    CASE WHEN ra IS NULL OR raw_artist = '' THEN NULL WHEN len(ws) > 1 AND tail > 0 THEN array_to_string(ws[1:len(ws) - tail], ' ') ELSE ra END AS artist_name,
    CASE WHEN len(ws) > 1 AND tail > 0 THEN array_to_string(ws[len(ws) - tail + 1:], ' ') END AS artist_honorifics,
    pn AS price_numeric, CASE WHEN rp IN ('', '*') THEN '*' WHEN upper(rp) = 'NFS' THEN 'NFS' WHEN pn IS NOT NULL THEN pn::VARCHAR ELSE rp END AS price_text,
    CASE WHEN et > 0 THEN et END AS edition_total, CASE WHEN et > 0 THEN ep END AS edition_price
  FROM {name}_2
)"""


_N = _normal("works", "n")
_TITLE_TOKENS = r"list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '\s+'), lambda x: upper(regexp_replace(x, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g'))), lambda x: x <> '')"
_EXCEPTED = f"x IN ({', '.join(repr(x.upper()) for x in TITLE_CASE_EXCEPTIONS)})"
_IS_ROMAN = f"len(x) > 1 AND x NOT IN ({', '.join(repr(x.upper()) for x in ROMAN_EXCLUDED)}) AND regexp_full_match(x, '{ROMAN}')"
_WARN = rf"""WITH {_N}, w AS (
  SELECT work_id, unnest(list_filter([
    CASE WHEN len(list_filter({_TITLE_TOKENS}, lambda x: {_EXCEPTED})) > 0 THEN 'title_case_exception' END, CASE WHEN len(list_filter({_TITLE_TOKENS}, lambda x: {_IS_ROMAN} AND NOT {_EXCEPTED})) > 0 THEN 'title_case_roman' END,
    CASE WHEN coalesce(raw_title <> {_TRIM("raw_title")}, false) OR coalesce(raw_artist <> {_TRIM("raw_artist")}, false) OR coalesce(raw_medium <> {_TRIM("raw_medium")}, false) THEN 'whitespace_trimmed' END,
    CASE WHEN coalesce(title, '') = '' THEN 'missing_title' END, CASE WHEN coalesce(artist_name, '') = '' THEN 'missing_artist' END,
    CASE WHEN price_numeric IS NULL AND price_text = '*' THEN 'missing_price' END, CASE WHEN price_numeric IS NULL AND price_text NOT IN ('*', 'NFS') THEN 'unrecognised_price' END,
    CASE WHEN coalesce({_TRIM("raw_edition")}, '') <> '' AND NOT regexp_matches(raw_edition, '^Edition of [0-9]+') THEN 'edition_anomaly' END,
    CASE WHEN regexp_matches(coalesce(raw_edition, ''), '^Edition of 0+([^0-9]|$)') THEN 'zero_edition_suppressed' END,
    CASE WHEN regexp_matches(concat(title, artist_name, medium), '[^\x00-\x7F]') THEN 'non_ascii_characters' END], lambda x: x IS NOT NULL)) AS type FROM n
)"""
_MONEY = lambda c: f"CASE WHEN {c} <> 0 THEN '£' || format('{{:,}}', {c}) END"
_EFFECTIVE = rf"""WITH {_N}, e AS (
  SELECT n.work_id, ord, cat_no, gallery, include_in_export, coalesce(title_override, title) AS title, coalesce(artist_name_override, artist_name) AS artist_name,
    coalesce(artist_honorifics_override, artist_honorifics) AS artist_honorifics, coalesce(price_text_override, price_text) AS price_text, coalesce(edition_total_override, edition_total) AS edition_total,
    edition_price, coalesce(medium_override, medium) AS medium, CASE WHEN coalesce(price_text_override, '') <> '' THEN NULL ELSE coalesce(price_numeric_override::BIGINT, price_numeric) END AS price_numeric
  FROM n LEFT JOIN overrides o ON o.work_id = n.work_id
), x AS (
  SELECT work_id, ord, cat_no, gallery, coalesce(title, '') AS title, coalesce(artist_name, '') AS artist_name, nullif(artist_honorifics, '') AS artist_honorifics,
    coalesce({_MONEY("price_numeric")}, nullif(price_text, '')) AS price_display,
    CASE WHEN edition_total <> 0 THEN '(edition of ' || edition_total || coalesce(' at ' || {_MONEY("edition_price")}, '') || ')' END AS edition_display, nullif(medium, '') AS medium
  FROM e WHERE include_in_export
)"""
_FOLD = lambda c: rf"lower(regexp_replace({_TRIM(f'coalesce({c}, {chr(39)*2})')}, '\s+', ' ', 'g'))"
_PRINT = f"{_FOLD('raw_title')} || chr(1) || {_FOLD('raw_artist')} || chr(1) || {_FOLD('raw_medium')}"
_MATCH = f"""WITH o AS (SELECT ord, cat_no AS number, {_PRINT} AS p FROM works), w AS (SELECT ord, cat_no AS number, {_PRINT} AS p FROM works_new),
f AS (SELECT number, min(ord) AS ord, arg_min(p, ord) AS p FROM w WHERE number IS NOT NULL GROUP BY number),
p1 AS (SELECT o.ord, f.ord AS new_ord FROM o JOIN f ON f.number = o.number AND f.p = o.p),
free AS (SELECT p, count(*) AS n, min(ord) AS ord FROM w WHERE ord NOT IN (SELECT new_ord FROM p1) GROUP BY p),
pending AS (SELECT o.*, row_number() OVER (PARTITION BY o.p ORDER BY o.ord) AS k, coalesce(free.n, 0) AS n, free.ord AS free_ord FROM o LEFT JOIN free ON free.p = o.p WHERE o.ord NOT IN (SELECT ord FROM p1)),
claimed AS (SELECT free_ord AS new_ord, ord AS by_ord FROM pending WHERE n = 1 AND k = 1),
rest AS (SELECT r.ord, f.ord AS c, f.ord IS NOT NULL AND f.ord NOT IN (SELECT new_ord FROM p1) AND NOT coalesce(claimed.by_ord < r.ord, false) AS ok
  FROM pending r LEFT JOIN f ON f.number = r.number LEFT JOIN claimed ON claimed.new_ord = f.ord WHERE n <= 1 AND NOT (n = 1 AND k = 1)),
plan AS (SELECT ord AS old_ord, 'cat_no' AS outcome, new_ord FROM p1 UNION ALL SELECT ord, 'fingerprint', free_ord FROM pending WHERE n = 1 AND k = 1
  UNION ALL SELECT ord, 'fingerprint_collision', NULL FROM pending WHERE n > 1
  UNION ALL SELECT ord, CASE WHEN ok THEN 'cat_no_match_fingerprint_mismatch' ELSE 'no_fingerprint_match' END, CASE WHEN ok THEN c END FROM rest)"""
_DIFF = f"""WITH {_N}, {_normal("works_new", "m")},
o AS (SELECT *, {_PRINT} AS p FROM n), w AS (SELECT *, {_PRINT} AS p FROM m),
a1 AS (SELECT ord, p, row_number() OVER (PARTITION BY p ORDER BY ord) AS k FROM o), b1 AS (SELECT ord, p, row_number() OVER (PARTITION BY p ORDER BY ord) AS k FROM w),
q1 AS (SELECT a1.ord AS old_ord, b1.ord AS new_ord FROM a1 JOIN b1 ON a1.p = b1.p AND a1.k = b1.k),
a2 AS (SELECT ord, cat_no, row_number() OVER (PARTITION BY cat_no ORDER BY ord) AS k FROM o WHERE cat_no IS NOT NULL AND ord NOT IN (SELECT old_ord FROM q1)),
b2 AS (SELECT ord, cat_no, row_number() OVER (PARTITION BY cat_no ORDER BY ord) AS k FROM w WHERE cat_no IS NOT NULL AND ord NOT IN (SELECT new_ord FROM q1)),
q AS (SELECT * FROM q1 UNION ALL SELECT a2.ord, b2.ord FROM a2 JOIN b2 ON a2.cat_no = b2.cat_no AND a2.k = b2.k),
j AS (SELECT old_ord, new_ord, unnest([
  {", ".join(f"CASE WHEN o.{f} IS DISTINCT FROM w.{f} THEN {{'f': '{f}', 'c': CASE WHEN o.{r} IS DISTINCT FROM w.{r} THEN 'source' ELSE 'normalisation' END}} END" for f, r in (("title", "raw_title"), ("artist_name", "raw_artist"), ("medium", "raw_medium"), ("price_text", "raw_price"), ("edition_total", "raw_edition")))},
  CASE WHEN o.cat_no IS DISTINCT FROM w.cat_no THEN {{'f': 'cat_no', 'c': 'source'}} END, CASE WHEN o.gallery IS DISTINCT FROM w.gallery THEN {{'f': 'section', 'c': 'source'}} END,
  CASE WHEN o.include_in_export IS DISTINCT FROM w.include_in_export THEN {{'f': 'include_in_export', 'c': 'override'}} END]) AS x
  FROM q JOIN o ON o.ord = old_ord JOIN w ON w.ord = new_ord),
d AS (SELECT old_ord, new_ord, x.f AS field, x.c AS cause FROM j WHERE x IS NOT NULL
  UNION ALL SELECT ord, NULL, 'removed', NULL FROM o WHERE ord NOT IN (SELECT old_ord FROM q) UNION ALL SELECT NULL, ord, 'added', NULL FROM w WHERE ord NOT IN (SELECT new_ord FROM q))"""
_EXPORT = ("title", "artist_name", "artist_honorifics", "price_text", "edition_total", "medium", "gallery")


def _keyed(source: str) -> str:
    return f"SELECT *, CASE WHEN k = 1 AND base <> '__unnamed' THEN base ELSE base || '__' || k END AS key FROM (SELECT *, coalesce(cat_no, '__unnamed') AS base, row_number() OVER (PARTITION BY coalesce(cat_no, '__unnamed') ORDER BY ord) AS k FROM {source})"


_WORDS = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), ',.', '  '), '\s+'), lambda x: x <> ''))"
_NOT_IN = lambda a, b: f"list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
_COMPARE = rf"""c1 AS (
  SELECT *, list_filter(regexp_split_to_array(coalesce(name, ''), '\s+'), lambda x: x <> '') AS np, coalesce(title, '') AS t, CASE WHEN is_company THEN '' ELSE {_TRIM("coalesce(first, '')")} END AS fi, {_TRIM("coalesce(last, '')")} AS li,
    list_sort({_WORDS("honorifics")}) AS lq, list_sort({_WORDS("quals")}) AS iq FROM pairs
), c2 AS (SELECT *, coalesce(np[len(np)], '') AS ll, array_to_string(np[1:len(np)-1], ' ') AS lf FROM c1
), c3 AS (
  SELECT *, ll <> '' AND lower(ll) = lower(li) AS lm,
    lower(lf) = lower(fi) OR (t <> '' AND (lower(lf) = lower(trim(t || ' ' || fi)) OR (lf <> '' AND len({_NOT_IN(_WORDS("lf"), f"list_append({_WORDS('fi')}, rtrim(lower(t), '.'))")}) = 0))) AS fm,
    lower(trim(lf || ' ' || ll)) || ' ' || array_to_string(lq, ' ') = lower(trim(fi || ' ' || li)) || ' ' || array_to_string(iq, ' ') AS ex,
    list_filter(lq, lambda x: x IN ('ra', 'pra', 'ppra', 'honra')) AS lra, list_filter(iq, lambda x: x IN ('ra', 'pra', 'ppra', 'honra')) AS ira,
    list_filter(lq, lambda x: x NOT IN ('ra', 'pra', 'ppra', 'honra')) AS lo, list_filter(iq, lambda x: x NOT IN ('ra', 'pra', 'ppra', 'honra')) AS io,
    list_sort(list_distinct(list_concat({_WORDS("name")}, lq))) AS a, list_sort(list_distinct(list_concat(list_concat({_WORDS("fi")}, {_WORDS("li")}), iq))) AS b FROM c2
), compared AS (
  SELECT *, CASE WHEN ex THEN 'exact' WHEN lm AND fm THEN CASE WHEN lra <> ira THEN 'partial_ra' WHEN lo <> io THEN 'partial_honorific' ELSE 'exact' END
    WHEN lm AND t <> '' THEN CASE WHEN lra <> ira THEN 'partial_ra' WHEN lo <> io THEN 'partial_honorific' ELSE 'partial_title' END WHEN lm THEN 'partial_name'
    WHEN len(a) > 0 AND a = b THEN 'equivalent' WHEN list_has_any(a, b) THEN 'partial_name' ELSE 'none' END AS level,
    CASE WHEN ex THEN '' ELSE array_to_string(list_filter([CASE WHEN NOT lm THEN 'last_name_different' END,
      CASE WHEN NOT fm THEN CASE WHEN t <> '' AND lm THEN 'title_in_index_not_in_low' ELSE 'first_name_different' END END,
      {", ".join(f"CASE WHEN len({_NOT_IN(x, y)}) > 0 THEN '{k}:' || array_to_string({_NOT_IN(x, y)}, ', ') END" for k, x, y in (("extra_ra_in_index", "ira", "lra"), ("extra_ra_in_low", "lra", "ira"), ("extra_quals_in_index", "io", "lo"), ("extra_quals_in_low", "lo", "io")))}
    ], lambda x: x IS NOT NULL), '; ') END AS differences FROM c3
)"""
_NUMBERS = r"list_transform(list_filter(list_transform(regexp_split_to_array(cat_nos, '[;,]'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::INT)"
_EMPTY = lambda c: f"coalesce(trim({c}), '') = ''"
_COMPANY = f"NOT {_EMPTY('last_name')} AND {_EMPTY('first_name')} AND {_EMPTY('quals')}"
_ENTRIES = f"""WITH {_N},
l AS (SELECT cat_no::INT AS number, arg_max({{'name': artist_name, 'h': artist_honorifics}}, ord) AS l FROM n WHERE regexp_full_match(cat_no, '[0-9]+') GROUP BY ALL),
i AS (SELECT number, arg_max({{'title': title, 'first': first_name, 'last': last_name, 'quals': quals, 'c': {_COMPANY}}}, row_number) AS i FROM (SELECT *, unnest({_NUMBERS}) AS number FROM index_artists) GROUP BY number),
pairs AS (SELECT coalesce(l.number, i.number) AS number, l IS NULL AS no_low, i IS NULL AS no_index, l.name AS name, l.h AS honorifics, i.title AS title, i.first AS first, i.last AS last, i.quals AS quals, coalesce(i.c, false) AS is_company FROM l FULL JOIN i ON l.number = i.number),
{_COMPARE}, entries AS (SELECT number AS cat_no, CASE WHEN no_low OR no_index THEN 'none' ELSE level END AS level, CASE WHEN no_index THEN 'missing_in_index' WHEN no_low THEN 'missing_in_low' ELSE differences END AS differences FROM compared)"""
_LEVELS = ("exact", "equivalent", "partial_title", "partial_honorific", "partial_ra", "partial_name", "none")

_NAMESAKES = "SELECT * REPLACE (regexp_replace(first_name, '[0-9]+$', '') AS first_name, regexp_replace(last_name, '[0-9]+$', '') AS last_name) FROM index_artists"

ORACLES = {
    "normalise_works": with_views(f"WITH {_N} SELECT work_id, title, artist_name, artist_honorifics, price_numeric, price_text, edition_total, edition_price FROM n", "works"),
    "all_work_warnings": with_views(f"{_WARN} SELECT * FROM w", "works"),
    "all_warning_counts": with_views(f"{_WARN} SELECT type, count(*) AS n FROM w GROUP BY type", "works"),
    "work_warnings": with_views(f"{_WARN} SELECT * FROM w", "works"),
    "warning_counts": with_views(f"{_WARN} SELECT type, count(*) AS n FROM w GROUP BY type", "works"),
    "effective_works": with_views(f"{_EFFECTIVE} SELECT * EXCLUDE (ord) FROM x", "works", "overrides"),
    "section_positions": with_views("WITH s AS (SELECT coalesce(nullif(gallery, ''), 'Uncategorised') AS gallery, work_id, ord FROM works), g AS (SELECT gallery, row_number() OVER (ORDER BY min(ord)) AS section_position FROM s GROUP BY gallery) SELECT work_id, s.gallery, section_position::INT AS section_position, row_number() OVER (PARTITION BY s.gallery ORDER BY ord)::INT AS position FROM s JOIN g ON g.gallery = s.gallery", "works"),
    "gallery_summary": with_views("SELECT gallery, count(*) AS works, min(TRY_CAST(cat_no AS INT)) AS lowest, max(TRY_CAST(cat_no AS INT)) AS highest, row_number() OVER (ORDER BY min(ord))::INT AS position FROM works GROUP BY gallery", "works"),
    "override_stats": with_views("SELECT gallery, count(*) AS works, count(o.work_id) AS overridden FROM works LEFT JOIN overrides o ON o.work_id = works.work_id GROUP BY gallery", "works", "overrides"),
    "without_override": with_views("SELECT work_id, cat_no FROM works WHERE work_id NOT IN (SELECT work_id FROM overrides)", "works", "overrides"),
    "search_works": with_views("SELECT work_id, cat_no FROM works WHERE lower(concat_ws(' ', cat_no, raw_artist, raw_title)) LIKE '%77%'", "works"),
    "match_plan": with_views(f"{_MATCH} SELECT * FROM plan", "works", "works_new"),
    "match_counts": with_views(f"{_MATCH} SELECT outcome, count(*) AS n FROM plan GROUP BY outcome", "works", "works_new"),
    "cross_gallery_moves": with_views(f"WITH f AS (SELECT {_PRINT} AS p, arg_min(gallery, ord) AS old_gallery FROM works GROUP BY 1) SELECT ord, old_gallery, gallery FROM (SELECT *, {_PRINT} AS p FROM works_new) w JOIN f ON f.p = w.p WHERE old_gallery <> gallery", "works", "works_new"),
    "state_diff": with_views(f"{_DIFF} SELECT * FROM d", "works", "works_new"),
    "state_diff_counts": with_views(f"{_DIFF} SELECT field, cause, count(*) AS n FROM d GROUP BY ALL", "works", "works_new"),
    "export_diff": with_views(f"""WITH {_N}, {_normal("works_new", "m")}, a AS ({_keyed("n")}), b AS ({_keyed("m")}),
      d AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS kind,
        array_to_string(list_filter([{", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _EXPORT)}], lambda x: x IS NOT NULL), ',') AS c FROM a FULL JOIN b ON a.key = b.key)
      SELECT key, kind, CASE WHEN kind = 'changed' THEN c END AS changed FROM d WHERE kind <> 'changed' OR c <> ''""", "works", "works_new"),
    "section_alignment": with_views("""WITH a AS (SELECT cat_no, arg_min(gallery, ord) AS section FROM works WHERE cat_no IS NOT NULL GROUP BY 1), b AS (SELECT cat_no, arg_min(gallery, ord) AS other, min(ord) AS ord FROM works_new WHERE cat_no IS NOT NULL GROUP BY 1),
      c AS (SELECT section, other, count(*) AS shared, min(ord) AS first FROM a JOIN b ON a.cat_no = b.cat_no GROUP BY ALL)
      SELECT section, other AS aligned, shared FROM c QUALIFY row_number() OVER (PARTITION BY section ORDER BY shared DESC, first, other) = 1""", "works", "works_new"),
    "compare_entries": with_views(f"{_ENTRIES} SELECT * FROM entries", "works", "index_artists"),
    "compare_summary": with_views(f"{_ENTRIES} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (level = '{x}') AS match_{x}''' for x in _LEVELS)}, count(*) FILTER (differences = 'missing_in_index') AS only_in_low, count(*) FILTER (differences = 'missing_in_low') AS only_in_index FROM entries", "works", "index_artists"),
    "name_comparison": with_views(f"""WITH pairs AS (SELECT artist_id, CASE artist_id % 4 WHEN 0 THEN concat_ws(' ', first_name, last_name) WHEN 1 THEN 'Other ' || last_name WHEN 2 THEN concat_ws(' ', title, first_name, last_name) ELSE concat_ws(' ', last_name, first_name) END AS name,
      CASE artist_id % 3 WHEN 0 THEN 'RA' WHEN 1 THEN 'OBE RA' END AS honorifics, title, first_name AS first, last_name AS last, quals, false AS is_company FROM index_artists), {_COMPARE} SELECT artist_id, level, differences FROM compared""", "index_artists"),
    "effective_artists": with_views("""WITH k AS (SELECT * FROM known_artists QUALIFY row_number() OVER (PARTITION BY match_first, match_last, match_quals ORDER BY is_seeded, rule_id) = 1)
      SELECT artist_id, CASE WHEN r.resolved_first IS NOT NULL THEN nullif(r.resolved_first, '') ELSE first_name END AS first_name, CASE WHEN r.resolved_last IS NOT NULL THEN nullif(r.resolved_last, '') ELSE last_name END AS last_name, title, quals, r.rule_id
      FROM (SELECT a.*, CASE WHEN x.rule_id IS NOT NULL THEN {'resolved_first': x.resolved_first, 'resolved_last': x.resolved_last, 'rule_id': x.rule_id} WHEN w.rule_id IS NOT NULL THEN {'resolved_first': w.resolved_first, 'resolved_last': w.resolved_last, 'rule_id': w.rule_id} END AS r
        FROM index_artists a LEFT JOIN k x ON x.match_quals <> '' AND x.match_first = first_name AND x.match_last = last_name AND x.match_quals = quals LEFT JOIN k w ON w.match_quals = '' AND w.match_first = first_name AND w.match_last = last_name)""", "index_artists", "known_artists"),
    "index_names": with_views("SELECT artist_id, CASE WHEN coalesce(last_name, first_name, '') = '' THEN '' ELSE concat_ws(' ', concat_ws(', ', coalesce(last_name, first_name), CASE WHEN last_name IS NOT NULL AND first_name IS NOT NULL THEN concat_ws(' ', title, first_name) END), nullif(quals, '')) END AS index_name FROM index_artists", "index_artists"),
    "artist_flags": with_views(rf"SELECT artist_id, coalesce(regexp_matches(quals, '(?i)\b(RA ELECT|EX OFFICIO|HON RA|HONRA|PPRA|PRA|RA)\b'), false) AS is_member, {_COMPANY} AS is_company, coalesce(regexp_matches(first_name, '(?i)\band\b|\bwith\b|\s&\s'), false) OR coalesce(regexp_matches(last_name, '(?i)\band\b|\bwith\b|\s&\s'), false) AS is_multi, array_to_string({_NUMBERS}, ',') AS numbers FROM index_artists", "index_artists"),
    "merged_artists": with_views(f"""WITH a AS (SELECT *, {" || '|' || ".join(f"lower(trim(coalesce({c}, '')))" for c in ("title", "first_name", "last_name", "quals"))} AS key, {_NUMBERS} AS x FROM index_artists)
      SELECT key, min(row_number) AS row_number, array_to_string(flatten(list(x ORDER BY row_number)), ',') AS numbers, count(*) AS rows FROM a WHERE courtesy IS NULL GROUP BY key UNION ALL SELECT key, row_number, array_to_string(x, ','), 1 FROM a WHERE courtesy IS NOT NULL""", "index_artists"),
    "letter_groups": with_views("SELECT CASE WHEN coalesce(x, '') = '' THEN '?' WHEN regexp_full_match(x, '[0-9]') THEN '#' ELSE x END AS letter, count(*) AS entries FROM (SELECT upper(left(coalesce(last_name, first_name), 1)) AS x FROM index_artists) GROUP BY 1", "index_artists"),
    "linked_entries": with_views("SELECT artist_id, name, n FROM (SELECT artist_id, lower(concat_ws(' ', last_name, first_name)) AS name, count(*) OVER (PARTITION BY lower(concat_ws(' ', last_name, first_name))) AS n FROM index_artists) WHERE n > 1", "index_artists"),
    "tag_round_trip": with_views(f"{_EFFECTIVE} SELECT ord, cat_no, nullif(title, '') AS title, nullif(artist_name, '') AS artist_name, price_display, medium FROM x WHERE cat_no <> ''", "works", "overrides"),
    "audit_latest": "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "audit_windows": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sort_keys": r"SELECT doc_id, strip_accents(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS sort_key FROM documents",
    "document_sort_keys": r"SELECT doc_id, strip_accents(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS sort_key FROM documents",
    "artist_sort_keys": with_views("SELECT artist_id, strip_accents(lower(trim(CASE WHEN coalesce(last_name, '') = '' THEN coalesce(first_name, '') ELSE last_name || ' ' || coalesce(first_name, '') END))) AS sort_key FROM index_artists", "index_artists"),
    "merged_index_warnings": with_views(f"""WITH namesakes AS ({_NAMESAKES}), a AS (SELECT row_number, {" || '|' || ".join(f"lower(trim(coalesce({c}, '')))" for c in ("title", "first_name", "last_name", "quals"))} AS key FROM namesakes WHERE courtesy IS NULL)
      SELECT min(row_number) AS row_number, 'duplicate_name_merged' AS type, 'Merged from ' || count(*) || ' rows: ' || arg_min(name, row_number) AS message FROM (SELECT a.*, concat_ws(', ', last_name, first_name) AS name FROM a JOIN namesakes i ON i.row_number = a.row_number) GROUP BY key HAVING count(*) > 1""", "index_artists"),
    "merged_number_chunks": with_views(f"""WITH namesakes AS ({_NAMESAKES}), a AS (SELECT row_number, {" || '|' || ".join(f"lower(trim(coalesce({c}, '')))" for c in ("title", "first_name", "last_name", "quals"))} AS key, {_NUMBERS} AS x FROM namesakes WHERE courtesy IS NULL),
      e AS (SELECT key, row_number, unnest(x) AS n, unnest(range(1, len(x) + 1)) AS i FROM a), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_number, i) AS place FROM e)
      SELECT key, ((place - 1) // 3)::BIGINT AS chunk, string_agg(n::VARCHAR, ',' ORDER BY place) AS numbers FROM p GROUP BY ALL""", "index_artists"),
}
