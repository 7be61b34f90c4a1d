"""Catalogue inputs as deterministic views of the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORKS = """
SELECT p_partkey AS work_id, p_partkey AS ord, CAST(p_partkey AS STRING) AS cat_no, p_brand AS gallery,
  CASE WHEN p_partkey % 11 = 0 THEN concat('  ', upper(p_name), ' ') WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN concat(p_name, '... IV') ELSE p_name END AS raw_title,
  CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN concat(p_name, ' RA') WHEN p_partkey % 5 = 2 THEN concat(p_name, ' Hon RA') WHEN p_partkey % 5 = 3 THEN concat(p_name, ' OBE') WHEN p_partkey % 37 = 0 THEN 'HON RA' ELSE p_name END AS raw_artist,
  CASE p_partkey % 8 WHEN 0 THEN concat('£1,', CAST(100 + p_partkey % 900 AS STRING)) WHEN 1 THEN 'NFS' WHEN 2 THEN '*' WHEN 3 THEN NULL WHEN 4 THEN 'POA' WHEN 5 THEN '1.2.3' WHEN 6 THEN concat(CAST(p_size AS STRING), '.75') ELSE concat(' ', CAST(p_size AS STRING), ' ') END AS raw_price,
  CASE p_partkey % 6 WHEN 0 THEN concat('Edition of ', CAST(p_size AS STRING), ' at £1,', CAST(100 + p_size AS STRING)) WHEN 1 THEN 'Edition of 0' WHEN 2 THEN concat('Edition of ', CAST(p_size AS STRING)) WHEN 3 THEN 'about 5' WHEN 4 THEN 'Edition of 3 at ,' ELSE NULL END AS raw_edition,
  p_type AS raw_medium, p_partkey % 17 <> 0 AS include_in_export
FROM part"""

OVERRIDES = """
SELECT p_partkey AS work_id,
  CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' (revised)') WHEN p_partkey % 3 = 1 THEN '' END AS title_override,
  CASE WHEN p_partkey % 5 = 0 THEN 'Someone Else' END AS artist_name_override,
  CASE WHEN p_partkey % 4 = 0 THEN 'CBE' END AS artist_honorifics_override,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 10 AS DECIMAL(12,2)) END AS price_numeric_override,
  CASE WHEN p_partkey % 9 = 0 THEN 'on application' WHEN p_partkey % 9 = 1 THEN '' END AS price_text_override,
  CASE WHEN p_partkey % 6 = 0 THEN p_size END AS edition_total_override,
  CASE WHEN p_partkey % 8 = 0 THEN 'mixed media' END AS medium_override
FROM part WHERE p_partkey % 7 = 0"""

WORKS_NEW = """
SELECT ord, CASE WHEN ord % 400 BETWEEN 101 AND 140 THEN CAST(ord + 1 AS STRING) WHEN ord % 43 = 0 THEN NULL ELSE cat_no END AS cat_no,
  CASE WHEN ord % 61 = 0 THEN 'Brand#99' ELSE gallery END AS gallery,
  CASE WHEN ord % 53 = 0 THEN raw_title || ' II' WHEN ord % 71 = 0 THEN 'Untitled' ELSE raw_title END AS raw_title,
  CASE WHEN ord % 71 = 0 THEN 'Anonymous' ELSE raw_artist END AS raw_artist, raw_price, raw_edition,
  CASE WHEN ord % 71 = 0 THEN 'Oil' ELSE raw_medium END AS raw_medium, include_in_export
FROM works WHERE ord % 97 <> 0
UNION ALL
SELECT ord + 1000000, CAST(ord + 1000000 AS STRING), gallery, 'New ' || raw_title, raw_artist, raw_price, raw_edition, raw_medium, include_in_export
FROM works WHERE ord % 89 = 0
UNION ALL
SELECT ord + 2000000, cat_no, gallery, raw_title, raw_artist, raw_price, raw_edition, raw_medium, include_in_export
FROM works WHERE ord % 83 = 0"""

INDEX_ARTISTS = """
SELECT s_suppkey AS artist_id, s_suppkey AS row_number,
  CASE WHEN s_suppkey % 6 = 0 THEN 'Dr' END AS title,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN concat('Ann and ', s_name) ELSE concat('First', CAST(s_suppkey % 40 AS STRING)) END AS first_name,
  CASE WHEN s_suppkey % 11 = 0 THEN 'Boyd & Evans' ELSE concat('Last', CAST(s_suppkey % 50 AS STRING)) END AS last_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'RA' WHEN 1 THEN 'OBE RA' WHEN 2 THEN 'FRSA' WHEN 3 THEN '' END AS quals,
  CASE WHEN s_suppkey % 13 = 0 THEN 'Studio' END AS courtesy,
  concat(CAST(s_suppkey * 3 AS STRING), '; ', CAST(s_suppkey * 5 + 1 AS STRING), ', x', CAST(s_suppkey AS STRING)) AS cat_nos
FROM supplier"""

KNOWN_ARTISTS = """
SELECT concat('First', CAST(s_suppkey % 40 AS STRING)) AS match_first, concat('Last', CAST(s_suppkey % 50 AS STRING)) AS match_last,
  CASE WHEN s_suppkey % 3 = 0 THEN 'RA' ELSE '' END AS match_quals,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('Known', CAST(s_suppkey AS STRING)) ELSE '' END AS resolved_first, CASE WHEN s_suppkey % 4 = 1 THEN 'KNOWN' END AS resolved_last,
  s_suppkey % 4 = 0 AS is_seeded, s_suppkey AS rule_id
FROM supplier WHERE s_suppkey % 8 IN (0, 3, 6)"""

INDEX_SOURCE = """
SELECT c_custkey AS row_number, c_custkey AS artist_id,
  CASE WHEN c_custkey % 6 = 0 THEN 'Dr' WHEN c_custkey % 35 = 0 THEN ' Sir ' END AS raw_title,
  CASE WHEN c_custkey % 18 = 0 THEN 'Adam Caruso RA' WHEN c_custkey % 9 = 0 THEN 'Lucy Orta CBE RA' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN 'Jane obe'
    WHEN c_custkey % 8 = 0 THEN concat(' First', CAST(c_custkey % 40 AS STRING)) ELSE concat('First', CAST(c_custkey % 40 AS STRING)) END AS raw_first_name,
  CASE WHEN c_custkey % 18 = 0 THEN 'and Peter St John' WHEN c_custkey % 9 = 0 THEN '& Jorge Orta OBE' WHEN c_custkey % 11 = 0 THEN concat(CAST(c_custkey % 90 AS STRING), ' Architects <x>')
    WHEN c_custkey % 41 = 0 THEN 'Boyd & Evans' ELSE concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 + 1 AS INT), 1), 'last', CAST(c_custkey % 50 AS STRING)) END AS raw_last_name,
  CASE c_custkey % 5 WHEN 0 THEN 'RA' WHEN 1 THEN 'OBE RA' WHEN 2 THEN 'FRSA' WHEN 3 THEN '' END AS raw_quals,
  CASE WHEN c_custkey % 13 = 0 THEN 'Studio Ltd' END AS raw_company, CASE WHEN c_custkey % 10 = 0 THEN 'c/o Gallery' END AS raw_address,
  CASE WHEN c_custkey % 10 = 0 THEN 'c/o Gallery' END AS courtesy, c_custkey % 17 <> 0 AS include_in_export,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat(CAST(c_custkey * 3 AS STRING), '; ', CAST(c_custkey * 5 + 1 AS STRING), ', x', CAST(c_custkey AS STRING)) END AS cat_nos
FROM customer"""

INDEX_RULES = """
SELECT concat('First', CAST(c_custkey % 40 AS STRING)) AS match_first_name, concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 + 1 AS INT), 1), 'last', CAST(c_custkey % 50 AS STRING)) AS match_last_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'RA' ELSE '' END AS match_quals, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Known' END AS resolved_first_name,
  CASE WHEN c_custkey % 4 = 0 THEN concat('Élan', CAST(c_custkey % 9 AS STRING)) END AS resolved_last_name, CASE WHEN c_custkey % 5 = 0 THEN 'Friends' END AS resolved_artist2_last_name,
  CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 2 = 0 END AS resolved_is_company, c_custkey % 3 = 0 AS is_seeded, c_custkey AS rule_id
FROM customer WHERE c_custkey % 4 IN (0, 1)"""

INDEX_EDITS = """
SELECT c_custkey AS row_number, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 5 THEN 'Edited' END AS first_name_override, CASE WHEN c_custkey % 15 = 0 THEN 'KBE' END AS quals_override,
  CASE WHEN c_custkey % 20 = 0 THEN true WHEN c_custkey % 20 = 5 THEN false END AS is_company_override, CASE WHEN c_custkey % 45 = 0 THEN true END AS artist2_shared_surname_override,
  CASE WHEN c_custkey % 25 = 0 THEN 'Atelier' END AS company_override
FROM customer WHERE c_custkey % 5 = 0"""

AUDIT = """
SELECT event_id, ts, user_id, event_type AS action, CASE WHEN event_id % 3 = 0 THEN user_id * 7 END AS work_id, CASE WHEN event_id % 3 = 1 THEN user_id END AS artist_id,
  CASE WHEN event_id % 5 = 0 THEN event_id % 4 END AS template_id, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 30 AS STRING) END AS import_id
FROM events"""

IMPORTS = """
SELECT CAST(n_nationkey AS STRING) AS import_id, n_name AS name, n_nationkey * 7 % 25 AS uploaded_at, concat('uploads/', n_name) AS stored_as FROM nation WHERE n_nationkey % 6 <> 5"""

UPLOADS = """
SELECT CASE WHEN n_nationkey % 4 = 3 THEN concat('uploads/old-', n_name) ELSE concat('uploads/', n_name) END AS path, n_name AS name, n_nationkey * 1000 + 17 AS size FROM nation"""

LISTED_WORKS = """
SELECT p_partkey AS work_id, CAST(p_partkey % 25 AS STRING) AS import_id, p_brand AS gallery FROM part WHERE p_partkey % 25 <> 7"""

EDITED = """
SELECT p_partkey AS work_id, p_partkey * 3 AS updated_at FROM part WHERE p_partkey % 7 = 0"""

OVERRIDES_NEW = """
SELECT p_partkey AS work_id, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' (revised)') WHEN p_partkey % 3 = 1 THEN 'again' END AS title_override,
  CASE WHEN p_partkey % 5 = 0 THEN 'Someone Else' END AS artist_name_override, CASE WHEN p_partkey % 4 = 1 THEN 'CBE' END AS artist_honorifics_override,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 10 AS DECIMAL(12,2)) END AS price_numeric_override, CASE WHEN p_partkey % 9 = 0 THEN 'on application' WHEN p_partkey % 9 = 1 THEN '' END AS price_text_override,
  CASE WHEN p_partkey % 6 = 0 THEN p_size END AS edition_total_override, CASE WHEN p_partkey % 8 = 0 THEN 'mixed media' END AS medium_override
FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 <> 1 OR p_partkey % 101 = 0"""

TEMPLATES = """
SELECT n_nationkey AS template_id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'index' ELSE 'list' END AS kind, n_nationkey % 5 = 0 AS archived, n_nationkey % 4 = 1 AS builtin FROM nation"""

VIEWS = {
    "templates": TEMPLATES, "works": WORKS, "overrides": OVERRIDES, "works_new": WORKS_NEW, "index_artists": INDEX_ARTISTS, "known_artists": KNOWN_ARTISTS, "index_source": INDEX_SOURCE, "index_rules": INDEX_RULES,
    "index_edits": INDEX_EDITS, "audit": AUDIT, "imports": IMPORTS, "uploads": UPLOADS, "listed_works": LISTED_WORKS, "edited": EDITED, "overrides_new": OVERRIDES_NEW,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view, lazily, without registering anything in the catalog."""
    text = VIEWS[name]
    if name == "works_new":
        text = f"WITH works AS ({WORKS}) {text}"
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "customer", "events", "nation") if f"FROM {t}" in text}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that starts with the derived views it needs."""
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
