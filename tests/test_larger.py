"""Queries on tables larger than the test data, or of other values, against their SQL."""

import duckdb
import pytest

from corpusloom.plans.catalogue import ORACLES, QUERIES

from .conftest import DATA, plain


@pytest.mark.parametrize("quantity", ["l_quantity * 1e6", "2.5e9", "2500", "2.5e6", "l_quantity", "2.5e12"])
def test_parameter_counts_of_any_size(spark, tmp_path, quantity):
    """Totals of thousands, millions and billions, and of many thousands of billions."""
    one = " LIMIT 1" if not quantity.startswith("l_") else ""
    key = "1" if one else "l_suppkey"
    duckdb.sql(f"COPY (SELECT l_returnflag, l_linestatus, l_linenumber, {quantity}::DOUBLE AS l_quantity, {key}::BIGINT AS l_suppkey FROM '{DATA}/lineitem.parquet'{one}) TO '{tmp_path}/lineitem.parquet'")
    ours = QUERIES["q_param_counts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = con.execute(ORACLES["q_param_counts"])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(ours.columns)
    assert [tuple(map(plain, r)) for r in ours.select(*names).collect()] == [tuple(map(plain, r)) for r in got.fetchall()]
