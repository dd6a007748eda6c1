"""Query registry and the derived inputs shared by queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_TOKEN = re.compile(r"\{(\w+)\}")

# Opened tables per session and folder, so that a schema is read once.
_OPENED: dict[tuple[str, str, str], DataFrame] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables, and derived inputs written in SQL both engines understand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _OPENED:
            _OPENED[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return _OPENED[key]

    def spread(self, name: str, key: str) -> DataFrame:
        """Table ``name`` dealt by ``key`` over all cores twice, for work on whole texts: a file may be one row group."""
        return getattr(self, name).repartition(2 * self.spark.sparkContext.defaultParallelism, key)

    def view(self, name: str) -> DataFrame:
        """Derived input ``name`` of ``VIEWS``."""
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        def source(match: re.Match) -> str:
            name = match.group(1)
            if name in VIEWS:
                return "(" + _TOKEN.sub(source, VIEWS[name]) + ")"
            alias = f"cataloom_{name}_{abs(hash(self.folder))}"
            getattr(self, name).createOrReplaceTempView(alias)
            return alias

        return self.spark.sql(_TOKEN.sub(source, text))


def _plain(text: str) -> str:
    def source(match: re.Match) -> str:
        name = match.group(1)
        if name in VIEWS:
            return "(" + _plain(VIEWS[name]) + ")"
        return name if name in TABLES else match.group(0)

    return _TOKEN.sub(source, text)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables)`` under ``name``; ``{view}`` in ``sql`` is replaced by that input."""
    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = _plain(sql)
        return fn

    return keep


_SLUG = "'c' || lpad(cast({0} as string), 9, '0')"

# Inputs of the engine's shapes, read off the given tables. No rows are dropped except where
# absence is the point (which customers ordered in a period).
VIEWS: dict[str, str] = {
    "catalog": f"""
        SELECT {_SLUG.format('c_custkey')} AS slug, c_custkey AS id, c_name AS name, n_name AS city, r_name AS province,
               CASE WHEN c_acctbal < -500 THEN NULL ELSE 50.75e0 + (c_custkey * 7919 % 3000) / 1000.0e0 END AS lat,
               CASE WHEN c_acctbal < -500 THEN NULL ELSE 3.2e0 + (c_custkey * 104729 % 4000) / 1000.0e0 END AS lon,
               'Street ' || cast(c_custkey % 977 as string) || 'b' AS street,
               cast(1000 + c_custkey % 9000 as string) || ' ' || chr(cast(65 + c_custkey % 26 as int)) || chr(cast(65 + c_custkey % 17 as int)) AS postcode,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE 'https://www.' || lower(c_mktsegment) || cast(c_custkey % 499 as string) || '.example.nl/' END AS site,
               CASE WHEN c_acctbal < -900 THEN 'removed' ELSE 'active' END AS status,
               CASE WHEN c_acctbal > 9700 AND c_custkey > 0 THEN {_SLUG.format('c_custkey - 1')} END AS duplicate_of,
               lower(c_mktsegment) AS segment
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "activity": """
        SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order, count(*) AS n_orders,
               cast(cast(floor(min(o_totalprice) / 20.0e0) as bigint) / 100.0e0 as decimal(9,2)) AS low_price
        FROM {orders} GROUP BY o_custkey""",
    # Previous snapshot: customers who ordered before 1997; new snapshot: who ordered since 2000.
    "old_snapshot": """
        SELECT slug, name, city, province, lat, lon, cast(CASE WHEN id % 29 = 0 THEN 'removed' ELSE 'active' END as string) AS status,
               cast(id % 3 as int) AS consecutive_missing, cast(first_order as date) AS first_seen
        FROM {catalog} c JOIN {activity} a ON c.id = a.o_custkey WHERE first_order < timestamp '1997-01-01 00:00:00'""",
    "new_snapshot": """
        SELECT slug, name, city, province, lat, lon, cast('active' as string) AS status, cast(0 as int) AS consecutive_missing, cast(NULL as date) AS first_seen
        FROM {catalog} c JOIN {activity} a ON c.id = a.o_custkey WHERE last_order >= timestamp '2000-01-01 00:00:00'""",
    "prices": """
        SELECT slug, name, city, province, id, CASE WHEN n_orders % 4 = 0 THEN 'free' WHEN n_orders % 7 = 0 THEN 'closed' WHEN n_orders % 11 = 0 THEN 'blocked_by_bot_protection' ELSE 'paid' END AS status,
               CASE WHEN n_orders % 4 = 0 OR n_orders % 7 = 0 OR n_orders % 11 = 0 THEN NULL ELSE low_price END AS price, n_orders, first_order, last_order
        FROM {catalog} c JOIN {activity} a ON c.id = a.o_custkey""",
    "ratings": """
        SELECT slug, cast((n_orders * 5 % 21 + 30) / 10.0e0 as decimal(3,1)) AS rating, cast(n_orders * 13 as int) AS reviews
        FROM {catalog} c JOIN {activity} a ON c.id = a.o_custkey WHERE n_orders > 6""",
    # Catalogue-like rows from parts: price spread over the bands, some without a score.
    "items": """
        SELECT 'p' || lpad(cast(p_partkey as string), 9, '0') AS slug, p_partkey AS id, p_name AS name, p_brand AS city, p_type AS province,
               CASE WHEN p_size % 9 = 0 THEN 'free' WHEN p_size % 13 = 0 THEN 'unknown' ELSE 'paid' END AS price_status,
               CASE WHEN p_size % 9 = 0 THEN cast(0 as decimal(9,2)) WHEN p_size % 13 = 0 THEN NULL
                    ELSE cast(cast(floor(p_retailprice) as bigint) * (p_partkey % 4 + 1) / 160.0e0 as decimal(9,2)) END AS price,
               CASE WHEN p_size % 10 = 7 THEN NULL ELSE cast((p_partkey * 5 % 21 + 30) / 10.0e0 as decimal(3,1)) END AS rating,
               cast(p_partkey % 83 as int) AS reviews
        FROM {part}""",
    # User lists from the event log: an owner's entries in event order.
    "list_items": """
        SELECT cast(user_id as string) AS owner, event_id AS pos, replace(replace(replace(replace(props, '"k":', ''), '}', ''), '{', ''), ' ', '') AS raw_item,
               event_type = 'purchase' AS visited, event_type AS note, ts
        FROM {events}""",
    # Claims about documents: quote and amount from the text, some altered.
    "claims": """
        SELECT 'd' || lpad(cast(doc_id as string), 9, '0') AS slug, doc_id, source AS name, lang AS city, text AS page_text,
               'https://www.' || source || '.example.org/' AS website,
               CASE lang WHEN 'en' THEN 'https://tickets.' || source || '.example.org/p' WHEN 'fr' THEN 'https://other.example.net/p' WHEN 'de' THEN 'http://www.' || source || '.example.org:8080/x' ELSE NULL END AS source_url,
               CASE doc_id % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'closed' WHEN 2 THEN 'unknown' ELSE 'paid' END AS status,
               CASE WHEN doc_id % 6 >= 3 OR doc_id % 12 = 0 THEN cast((n_chars % 100) / 2.0e0 as decimal(9,2)) END AS price,
               CASE WHEN doc_id % 5 = 0 THEN 'entree gratis voor iedereen' WHEN doc_id % 5 = 1 THEN split_part(text, '.', 1)
                    WHEN doc_id % 5 = 2 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)
                    WHEN doc_id % 5 = 3 THEN 'combi ' || split_part(text, ' ', 2) END AS quote,
               n_chars
        FROM {documents}""",
}
