"""Lists beyond a million rows, where rows of the new list share their place."""

import duckdb
import pytest

from quire.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The parts twice, a million apart, so that the added rows of the new list have places of others."""
    path = tmp_path_factory.mktemp("tables")
    duckdb.sql(f"COPY (SELECT * REPLACE ((p_partkey + i * 1000000)::BIGINT AS p_partkey) FROM '{SF}/part.parquet', range(2) r(i)) TO '{path}/part.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["match_plan", "scoped_plan", "match_counts", "state_diff", "state_diff_counts"])
def test_rows_that_share_a_place(spark, tables, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tables}/part.parquet'")
    expected = db.sql(ORACLES[name])
    got = QUERIES[name](spark, tables).select(*expected.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))
