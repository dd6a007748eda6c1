"""Link queries against their SQL where several pages have one address."""
import duckdb
import pytest

from cataloom.workloads import registry


@pytest.mark.parametrize("name", ["link_reachable", "link_distance"])
def test_pages_of_one_address(spark, tmp_path, name):
    a, other = "https://a.nl/x", "https://a.nl/X/"
    found = [a, "https://a.nl/1", a, "https://a.nl/2", other, a, "https://b.nl/", "https://a.nl/3", "https://b.nl/"]
    pages = [(i, u, f"<a href='{found[i * 5 % 9]}'>l</a>") for i, u in enumerate(found)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.SQL[name])
    assert df.columns == [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
