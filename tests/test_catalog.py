"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

from __future__ import annotations

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from tidemill.plans import catalog

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
KINDS = {"BIGINT": {"bigint"}, "INTEGER": {"int"}, "VARCHAR": {"string"}, "DOUBLE": {"double"}, "BOOLEAN": {"boolean"}, "TIMESTAMP": {"timestamp", "timestamp_ntz"}}


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as connection:
        for file in SF.glob("*.parquet"):
            connection.execute(f"create view {file.stem} as select * from '{file}'")
        yield connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, str(SF))
    rows, columns = frame.collect(), sorted(frame.columns)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert rows and len(columns) == len(set(columns))
        return
    result = duck.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    for c in columns:
        if kinds[c] in KINDS:
            assert dict(frame.dtypes)[c] in KINDS[kinds[c]], c
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
