"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = frame.where(frame.notna(), None)

    def cell(x):
        return repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(x.item() if hasattr(x, "item") else x) for x in row) for row in plain.values)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_agrees_with_sql(spark, tables, name):
    ours = entry_module.queries()[name](spark, SF).toPandas()
    theirs = tables.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0
