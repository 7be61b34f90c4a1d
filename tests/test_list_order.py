"""Rows of the new list that share their place count in the order of the list, as the SQL has it where one thread reads it."""

import duckdb
import pytest

from quire.operators import match, reconcile
from quire.operators.ordering import in_list_order, numbered
from quire.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The parts twice, a million apart, so that the added rows of the new list have places of others."""
    path = tmp_path_factory.mktemp("tables")
    duckdb.sql(f"COPY (SELECT * REPLACE ((p_partkey + i * 1000000)::BIGINT AS p_partkey) FROM '{SF}/part.parquet', range(2) r(i)) TO '{path}/part.parquet' (FORMAT parquet)")
    return str(path)


def test_numbered_breaks_ties(spark):
    rows = [(o, s, f"{o}{s}") for o in (1, 2) for s in (3, 1, 2)]
    df = spark.createDataFrame(rows, "ord long, seq long, v string").repartition(3)
    got = {r.v: r.rank for r in numbered(df, [], then=("seq",)).collect()}
    assert got == {v: i + 1 for i, (_, _, v) in enumerate(sorted(rows))}


def test_alignment_takes_the_first_of_the_list(spark):
    old = spark.createDataFrame([(1, "7", "A")], "ord long, cat_no string, gallery string")
    for galleries in (("B", "C"), ("C", "B")):
        new = spark.createDataFrame([(1, "7", g) for g in galleries], "ord long, cat_no string, gallery string").coalesce(1)
        assert match.section_alignment(old, in_list_order(new)).first().aligned == galleries[0]


def test_last_of_a_number_is_the_first_of_those_at_its_place(spark):
    for texts in (("x", "y"), ("y", "x")):
        rows = spark.createDataFrame([(1, "7", "early"), *((2, "7", t) for t in texts)], "ord long, cat_no string, title string").coalesce(1)
        assert reconcile._last(in_list_order(rows), "d").first().d.title == texts[0]


@pytest.mark.parametrize("name", ["section_alignment", "applied_reimport", "reconcile_findings", "reconcile_counts", "reconcile_works"])
def test_rows_that_share_a_place(spark, tables, name):
    db = duckdb.connect(config={"threads": 1})
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tables}/part.parquet'")
    expected = db.sql(ORACLES[name])
    got = QUERIES[name](spark, tables).select(*expected.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))
