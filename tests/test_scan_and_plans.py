"""The carry-forward scan against a loop, its spread over tasks, and the plans of the match family."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import ordering, tags
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stretch,scan", [(2, 31), (16, 24), (1, 62)])
def test_carried_is_a_loop(spark, monkeypatch, stretch, scan):
    monkeypatch.setattr(ordering, "STRETCH_BITS", stretch)
    monkeypatch.setattr(ordering, "SCAN_BITS", scan)
    rng, rows, expected = random.Random(stretch), [], {}
    for g in ("a", "b", None):
        last, at = None, rng.choice((0, -50))
        for _ in range(150):
            at += rng.choice((1, 1, 2, 9, 700, 1 << 40))
            value = f"{g}{at}" if rng.random() < 0.15 else None
            last = value or last
            rows.append((g, at, value, "x"))
            expected[g, at] = (value, last, "x")
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, ord long, v string, _value string")
    got = {(r.g, r.ord): (r.v, r.c, r._value) for r in ordering.carried(df.withColumnRenamed("_value", "extra"), ["g"], "v", "c").withColumnRenamed("extra", "_value").collect()}
    assert got == expected
    assert ordering.carried(df.limit(0).drop("_value"), ["g"], "v", "c").count() == 0


def test_one_document_spreads_over_tasks(spark):
    """A document of many stretches isn't one task's, and its entries keep the heading of a stretch before theirs."""
    n = 40 * ordering.STRETCH
    ids = spark.range(0, n, ordering.STRETCH // 32).select(F.lit("d").alias("document"), F.col("id").alias("ord"))
    head = F.col("ord") % (3 * ordering.STRETCH) == 0
    styled = ids.select("*", F.when(head, "SectionTitle").otherwise("CatalogueEntry").alias("style"), F.when(head, F.concat(F.lit("Room "), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("<CharStyle:CatNo>"), F.col("ord").cast("string"), F.lit("<CharStyle:>"))).alias("body"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = tags.parsed_entries(styled).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 40 * 32 - 14
    assert all(r.section == f"Room {int(r.cat_no) // (3 * ordering.STRETCH) * (3 * ordering.STRETCH)}" for r in rows)
    tasks = [r.task for r in rows]
    assert len(set(tasks)) >= 6 and max(tasks.count(t) for t in set(tasks)) < len(rows) / 2


def test_layout_without_a_number_style(spark):
    from dataclasses import replace

    from quire.config import Layout

    layout = replace(Layout(), styles={"title": "WorkTitle"})
    found = spark.createDataFrame([("d", 1, "CatalogueEntry", "<CharStyle:WorkTitle>A<CharStyle:>")], "document string, ord long, style string, body string")
    assert tags.parsed_entries(found, layout).count() == 0


def plan_of(spark, name):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    count = lambda pattern: len(re.findall(pattern, text))
    return {"scans": count("FileScan"), "shuffles": count(r"(?<!Reused)Exchange (?:hash|range|single)"), "python": count("ArrowEvalPython")}


def test_plans_of_the_match_family(spark):
    """One pass over each list (the new one's view has three branches), and shuffles that don't grow with uses."""
    plan = plan_of(spark, "match_plan")
    assert plan["scans"] <= 5 and plan["shuffles"] <= 9 and plan["python"] <= 5, plan
    diff = plan_of(spark, "state_diff")
    assert diff["scans"] <= 12 and diff["shuffles"] <= 18 and diff["python"] <= 8, diff
