"""Every registered query of the operators against its SQL on the smallest tables."""
import glob
import os

import duckdb
import pytest
from test_queries import table

import __spark_entry__ as entry
from cataloom.llm import queries
from cataloom.workloads import registry

NAMES = sorted(set(entry.queries()) - set(registry.QUERIES))


def test_all_are_registered():
    assert set(NAMES) == set(queries.QUERIES) | {"pipeline"} and len({n.split("_")[0] for n in NAMES if n != "pipeline"}) == 13


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    got = table(df.columns, df.collect())
    if name in queries.SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{small}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        result = con.execute(queries.SQL[name])
        assert got == table([d[0] for d in result.description], result.fetchall())
