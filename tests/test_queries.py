"""Every registered query against its SQL on the smallest tables."""
import datetime
import decimal
import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cataloom.workloads import registry

#: Queries of the library; those of the training-data operators are tested in tests/llm.
QUERIES, SQL = registry.QUERIES, entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = table(df.columns, df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        assert got == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_entry_without_the_training_operators(monkeypatch):
    """A missing dependency or an empty folder left of the subpackage takes no library query away."""
    monkeypatch.setitem(sys.modules, "cataloom.llm", None)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.SQL)
