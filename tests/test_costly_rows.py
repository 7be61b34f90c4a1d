"""What a row costs is computed once and by many tasks, also where a file of many rows is one split."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import report, tags
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plan_of(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_warnings_in_order_are_computed_behind_the_ranges(spark):
    """Bounds of ranges are sampled from what is below them, so the warnings mustn't be there."""
    plan = plan_of(spark, "warnings_in_order")
    assert plan.index("missing_artist") < plan.index("Exchange rangepartitioning")
    assert plan.count("missing_artist") == 1


def test_warnings_in_order_are_in_order(spark):
    rows = [tuple(r) for r in QUERIES["warnings_in_order"](spark, SF).select("created_at", "work_id", "type").collect()]
    assert rows == sorted(rows) and len(rows) > 2000


def test_in_time_order_of_repeats(spark):
    """Rows that share time and key are in order by what they have, nulls first."""
    rows = [(t, k, v) for t in (3, 1, None) for k in (2, 1) for v in ("b", "a")] * 2
    df = spark.createDataFrame(rows, "created_at long, work_id long, v string").repartition(3)
    out = report.in_time_order_of(df, lambda own: own.select("created_at", "work_id", F.explode(F.array(F.lit("z"), "v")).alias("type")))
    expected = [(t, k, v) for t, k, own in rows for v in ("z", own)]
    assert [tuple(r) for r in out.collect()] == sorted(expected, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("name,once", [("tag_round_trip", "<pstyle:entry>"), ("work_warnings", "missing_artist"), ("normalise_works", "Edition of")])
def test_rows_spread_before_they_cost(spark, name, once):
    plan = plan_of(spark, name)
    assert re.search(r"Exchange hashpartitioning\(work_id", plan)
    assert plan.index(once) < plan.index("Exchange hashpartitioning(work_id")


def test_lines_are_rendered_once(spark):
    assert plan_of(spark, "tag_round_trip").count("concat(<pstyle:entry>") == 1


def test_parse_entries_leaves_null_lines_out(spark):
    lines = spark.createDataFrame([(1, None), (2, "<pstyle:entry><cstyle:cat_no>7<cstyle:>"), (3, "<pstyle:entry>x"), (4, "other")], "ord long, line string")
    assert [(r.ord, r.cat_no) for r in tags.parse_entries(lines).collect()] == [(2, "7")]
