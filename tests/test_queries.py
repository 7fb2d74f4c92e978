"""Registered queries against their SQL in DuckDB, on the smallest tables; skipped where those are not there."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from foldsieve.plans import catalog

DATA = os.environ.get("FOLDSIEVE_TEST_DATA", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def database():
    if not Path(DATA).is_dir():
        pytest.skip("no tables")
    found = duckdb.connect()
    for table in Path(DATA).glob("*.parquet"):
        found.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return found


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, database, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.select(*columns).collect()), key=repr)
    cursor = database.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr) == got


def test_entry(spark):
    import __spark_entry__ as entry

    if Path("/root/testdata/sf0.001").is_dir():
        assert entry.entry(spark).count() == 1


def test_group_folds_predict_everyone_once(spark, database):
    rows = catalog.queries()["oof_predictions"](spark, DATA).collect()
    assert len({r.id for r in rows}) == len(rows) > 0
