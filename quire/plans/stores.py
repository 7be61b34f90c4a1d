"""Registered queries over tables that change: snapshots, imports, files and seeds, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..sources.files import scratch_path
from ..sources.store import FileStore, ImportTable, StateStore, seeded_table
from ..sources.views import view, with_views
from ..sources.workbooks import register, write_workbooks


def restored_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """A list after its newest snapshot was restored from the store; one of the writes is repeated."""
    rows = view(spark, sf, "works").select("work_id", "raw_title", "raw_price")
    store = StateStore(spark, scratch_path(spark, "states"), "work_id long, raw_title string, raw_price string")
    store.save(rows.where("work_id % 2 = 0"), "list", None, datetime(2025, 1, 1))
    for _ in range(2):
        store.save(rows.where("work_id % 3 = 0"), "list", "print", datetime(2025, 1, 2))
    store.save(rows, "other", None, datetime(2025, 1, 3))
    return store.restore(rows, "list", datetime(2025, 1, 4))


def stored_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each snapshot of a list and what was saved before a restore."""
    rows = view(spark, sf, "works").select("work_id", "gallery")
    store = StateStore(spark, scratch_path(spark, "states"), "work_id long, gallery string")
    for day, part in ((1, 2), (2, 3), (2, 3)):
        store.save(rows.where(f"work_id % {part} = 0"), "list", None, datetime(2025, 1, day))
    store.restore(rows, "list", datetime(2025, 1, 4))
    counts = store.log.rows().groupBy("entry").agg(F.count("*").alias("n"))
    return store.snapshots("list").join(counts, "entry", "left").select("template", "at", F.coalesce("n", F.lit(0)).alias("n"))


def _imports(spark: SparkSession, sf: str) -> ImportTable:
    table = ImportTable(spark, scratch_path(spark, "imports"), "work_id long, gallery string")
    works = view(spark, sf, "listed_works").select(F.col("work_id").cast("long").alias("work_id"), "gallery", "import_id")
    table.replace(works)
    table.replace(works.where("import_id = '3' and work_id % 2 = 0"))  # imported again, with fewer works
    return table


def works_of_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Works of two imports, one of which was imported again."""
    return _imports(spark, sf).rows("3", "11")


def listed_imports(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of lists whose upload is known, from their partitions alone."""
    imports = view(spark, sf, "imports").where("uploaded_at % 2 = 0")
    return report.list_stats(_imports(spark, sf).rows_of(imports), view(spark, sf, "edited"), imports)


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the store after some were saved again and some deleted, with the digest of what is loaded."""
    uploads = view(spark, sf, "uploads").select("path", F.col("name").cast("binary").alias("content"), "size")
    store = FileStore(spark, scratch_path(spark, "files"))
    store.save(uploads, "first")
    store.save(uploads.where("size % 2 = 0").withColumn("content", F.concat("content", F.lit("!").cast("binary"))), "second")
    store.delete(uploads.where("size % 5 = 0"), "third")
    loaded = store.load(uploads).select("key", F.sha2("content", 256).alias("sha256"))
    return store.listing().join(loaded, "key").select("key", "size", "sha256")


def stored_file_stats(spark: SparkSession, sf: str) -> DataFrame:
    uploads = view(spark, sf, "uploads")
    store = FileStore(spark, scratch_path(spark, "files"))
    store.save(uploads.select("path", F.col("name").cast("binary").alias("content")), "first")
    store.delete(uploads.where("size % 5 = 0"), "gone")
    return store.stats()


def seeded_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules after a new set of seeds was applied."""
    rules = view(spark, sf, "index_rules").select("rule_id", F.concat_ws("|", "match_first_name", "match_last_name").alias("content"), "is_seeded")
    n = F.col("rule_id")
    seeds = rules.where("is_seeded").where(n % 7 != 0).withColumn("content", F.when(n % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).union(rules.where(n % 11 == 0).withColumn("rule_id", n + 1_000_000))
    return seeded_table(rules, seeds.select("rule_id", "content"), ["rule_id"], ["content"])


def workbook_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The list's rows read back from workbooks that tasks wrote."""
    path = scratch_path(spark, "books")
    columns = {"Cat No": "cat_no", "Gallery": "gallery", "Title": "raw_title", "Artist": "raw_artist", "Price": "raw_price", "Edition": "raw_edition", "Medium": "raw_medium"}
    write_workbooks(view(spark, sf, "works").select("ord", *(F.col(c).alias(h) for h, c in columns.items())), path, most=500).write.format("noop").mode("overwrite").save()
    register(spark)
    rows = spark.read.format("workbook").option("layout", "works").load(path)
    return rows.select(*(F.col(h).alias(c) for h, c in columns.items()))


QUERIES = {f.__name__: f for f in (restored_from_store, stored_snapshots, works_of_imports, listed_imports, stored_files, stored_file_stats, seeded_rules, workbook_rows)}

_STORED = "SELECT * FROM listed_works WHERE import_id <> '3' OR work_id % 2 = 0"
_FILES = "SELECT split_part(path, '/', -1) AS key, size, CASE WHEN size % 2 = 0 THEN name || '!' ELSE name END AS content FROM uploads"
ORACLES = {
    "workbook_rows": with_views("SELECT cat_no, gallery, raw_title, raw_artist, raw_price, raw_edition, raw_medium FROM works", "works"),
    "restored_from_store": with_views("SELECT work_id, raw_title, raw_price FROM works WHERE work_id % 3 = 0", "works"),
    "stored_snapshots": with_views("SELECT NULL::VARCHAR AS template, TIMESTAMP '2025-01-01' AS \"at\", count(*) AS n FROM works WHERE work_id % 2 = 0 UNION ALL SELECT NULL, TIMESTAMP '2025-01-02', count(*) FROM works WHERE work_id % 3 = 0 UNION ALL SELECT 'pre_restore', TIMESTAMP '2025-01-04', count(*) FROM works", "works"),
    "works_of_imports": with_views(f"WITH s AS ({_STORED}) SELECT work_id, gallery, import_id FROM s WHERE import_id IN ('3', '11')", "listed_works"),
    "listed_imports": with_views(f"WITH s AS ({_STORED}), w AS (SELECT import_id, count(DISTINCT gallery) AS sections, count(*) AS works FROM s GROUP BY 1), o AS (SELECT import_id, count(*) AS overrides, max(updated_at) AS newest_override FROM s JOIN edited USING (work_id) GROUP BY 1) SELECT i.import_id, uploaded_at, coalesce(sections, 0) AS sections, coalesce(works, 0) AS works, coalesce(overrides, 0) AS overrides, newest_override FROM imports i LEFT JOIN w ON w.import_id = i.import_id LEFT JOIN o ON o.import_id = i.import_id WHERE uploaded_at % 2 = 0", "listed_works", "edited", "imports"),
    "stored_files": with_views(f"WITH f AS ({_FILES}) SELECT key, octet_length(encode(content))::BIGINT AS size, sha256(content) AS sha256 FROM f WHERE size % 5 <> 0", "uploads"),
    "stored_file_stats": with_views("SELECT count(*) AS files, sum(octet_length(encode(name)))::BIGINT AS bytes FROM uploads WHERE size % 5 <> 0", "uploads"),
    "seeded_rules": with_views("""SELECT rule_id, concat_ws('|', match_first_name, match_last_name) || CASE WHEN is_seeded AND rule_id % 5 = 0 THEN '!' ELSE '' END AS content, is_seeded, CASE WHEN NOT is_seeded THEN 'user' WHEN rule_id % 5 = 0 THEN 'update' ELSE 'keep' END AS action FROM index_rules WHERE NOT is_seeded OR rule_id % 7 <> 0
      UNION ALL SELECT rule_id + 1000000, concat_ws('|', match_first_name, match_last_name), true, 'insert' FROM index_rules WHERE rule_id % 11 = 0""", "index_rules"),
}
