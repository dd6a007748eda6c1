"""Snapshot, quality and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import localized_urls
from ..operators import audit, quality, snapshot, stores
from ..operators.overrides import apply_overrides
from ..operators.scale import fingerprint
from ..session import materialise, scratch_path
from ..sources import documents, publish
from .registry import Tables, query

HOST = "catalog.example.org"
_MERGED = """
    SELECT coalesce(n.slug, o.slug) AS slug, CASE WHEN n.slug IS NOT NULL THEN n.name ELSE o.name END AS name,
           CASE WHEN n.slug IS NOT NULL THEN n.city ELSE o.city END AS city, CASE WHEN n.slug IS NOT NULL THEN n.lat ELSE o.lat END AS lat,
           CASE WHEN n.slug IS NOT NULL THEN n.lon ELSE o.lon END AS lon,
           CASE WHEN n.slug IS NOT NULL THEN n.status WHEN o.consecutive_missing + 1 >= 2 OR o.status = 'removed' THEN 'removed' ELSE 'active' END AS status,
           CASE WHEN n.slug IS NOT NULL THEN 0 ELSE o.consecutive_missing + 1 END AS consecutive_missing,
           CASE WHEN n.slug IS NOT NULL THEN coalesce(o.first_seen, date '2001-09-01') ELSE o.first_seen END AS first_seen
    FROM {new_snapshot} n FULL OUTER JOIN {old_snapshot} o ON n.slug = o.slug"""


def _merged(t: Tables):
    return snapshot.soft_delete_merge(t.view("new_snapshot"), t.view("old_snapshot"), as_of="2001-09-01")


@query("soft_delete_merge", f"SELECT slug, name, city, status, cast(consecutive_missing as int) AS consecutive_missing, first_seen FROM ({_MERGED})")
def soft_delete_merge(t: Tables):
    return _merged(t).select("slug", "name", "city", "status", "consecutive_missing", "first_seen")


@query("snapshot_diff", f"""
    WITH m AS ({_MERGED}), keys AS (
      SELECT coalesce(m.slug, o.slug) AS slug, coalesce(m.status <> 'removed', false) AS now, coalesce(o.status <> 'removed', false) AS was, o.slug IS NOT NULL AS known
      FROM m FULL OUTER JOIN {{old_snapshot}} o ON m.slug = o.slug)
    SELECT slug, CASE WHEN now AND was THEN 'retained' WHEN now AND known THEN 'restored' WHEN now THEN 'added' ELSE 'removed' END AS change FROM keys WHERE now OR was""")
def snapshot_diff(t: Tables):
    return snapshot.snapshot_diff(_merged(t), t.view("old_snapshot"), active_keys=True)


@query("snapshot_diff_keys", f"""
    WITH m AS (SELECT slug FROM {{new_snapshot}}), o AS (SELECT slug FROM {{old_snapshot}})
    SELECT coalesce(m.slug, o.slug) AS slug, CASE WHEN o.slug IS NULL THEN 'added' WHEN m.slug IS NULL THEN 'removed' ELSE 'retained' END AS change FROM m FULL OUTER JOIN o ON m.slug = o.slug""")
def snapshot_diff_keys(t: Tables):
    """All keys of two runs, whatever their status."""
    return snapshot.snapshot_diff(t.view("new_snapshot"), t.view("old_snapshot"))


@query("validate_dataset", f"""
    WITH m AS ({_MERGED}), cur AS (SELECT * FROM m WHERE status <> 'removed'), prev AS (SELECT * FROM {{old_snapshot}} WHERE status <> 'removed'),
    s AS (SELECT (SELECT count(*) FROM cur) AS n, (SELECT count(*) FROM prev) AS p, (SELECT count(*) FROM cur WHERE city <> '' AND lat IS NOT NULL AND lon IS NOT NULL) AS c,
                 (SELECT count(*) FROM cur WHERE slug NOT IN (SELECT slug FROM prev)) AS a, (SELECT count(*) FROM prev WHERE slug NOT IN (SELECT slug FROM cur)) AS r,
                 (SELECT count(*) FROM (SELECT slug FROM m GROUP BY slug HAVING count(*) > 1)) AS d)
    SELECT n AS active_count, p AS base_count, round(abs(n - p) / p * 100.0e0, 1) AS count_change_pct, d AS duplicate_keys, round(c / n * 100.0e0, 1) AS complete_pct,
           round(a / p * 100.0e0, 1) AS added_pct, round(r / p * 100.0e0, 1) AS removed_pct,
           concat_ws(',', CASE WHEN n < 100 THEN 'min_count' END, CASE WHEN abs(n - p) / p * 100.0e0 > 20 THEN 'count_change' END, CASE WHEN d > 0 THEN 'key_uniqueness' END,
                     CASE WHEN c / n * 100.0e0 < 95 THEN 'completeness' END, CASE WHEN a / p * 100.0e0 > 10 THEN 'turnover_added' END, CASE WHEN r / p * 100.0e0 > 10 THEN 'turnover_removed' END) AS failed_rules
    FROM s""")
def validate_dataset(t: Tables):
    verdict = quality.dataset_verdict(_merged(t), t.view("old_snapshot"))
    return verdict.select("active_count", "base_count", "count_change_pct", "duplicate_keys", "complete_pct", "added_pct", "removed_pct", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("changelog_entry", f"""
    WITH m AS ({_MERGED}), a AS (SELECT slug FROM m WHERE status <> 'removed'), b AS (SELECT slug FROM {{old_snapshot}} WHERE status <> 'removed')
    SELECT date '2001-09-01' AS date, (SELECT count(*) FROM a WHERE slug NOT IN (SELECT slug FROM b)) AS added, (SELECT count(*) FROM b WHERE slug NOT IN (SELECT slug FROM a)) AS removed, (SELECT count(*) FROM m) AS total_count""")
def changelog_entry(t: Tables):
    merged = _merged(t)
    diff = snapshot.snapshot_diff(merged, t.view("old_snapshot"), active_keys=True)
    return snapshot.changelog_entry(diff, merged, "2001-09-01 10:00:00").drop("timestamp")


@query("run_meta", f"SELECT cast('2001-09-01' as date) AS checked, 'b1' AS build_id, count(*) AS total_count FROM ({_MERGED})")
def run_meta(t: Tables):
    return publish.run_meta(_merged(t), "2001-09-01 10:00:00", "b1").select(F.to_date("last_checked").alias("checked"), "build_id", "total_count")


_FEED_REASON = "CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'unpublished or startpage' END"


def _feed_rows(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("slug"), (F.col("o_orderpriority") == "1-URGENT").alias("is_startpage"),
                           F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"))


@query("reconcile_split", f"SELECT o_orderkey AS slug, {_FEED_REASON} AS reason FROM orders")
def reconcile_split(t: Tables):
    return snapshot.reconcile_published(_feed_rows(t)).select("slug", "reason")


@query("run_report", f"""
    WITH m AS ({_MERGED}), f AS (SELECT {_FEED_REASON} AS reason FROM orders), a AS (SELECT slug FROM m WHERE status <> 'removed'),
    b AS (SELECT slug FROM {{old_snapshot}} WHERE status <> 'removed'), v AS (
      SELECT 'total_embedded' AS metric, count(*)::double AS value FROM f UNION ALL SELECT 'active_count', count(*) FROM f WHERE reason IS NULL
      UNION ALL SELECT 'excluded_count', count(*) FROM f WHERE reason IS NOT NULL
      UNION ALL SELECT 'added_count', count(*) FROM a WHERE slug NOT IN (SELECT slug FROM {{old_snapshot}})
      UNION ALL SELECT 'removed_count', count(*) FROM b WHERE slug NOT IN (SELECT slug FROM a)
      UNION ALL SELECT 'retained_count', count(*) FROM b WHERE slug IN (SELECT slug FROM a)
      UNION ALL SELECT 'processed_count', count(*) FROM m UNION ALL SELECT 'complete_count', count(lat) FROM m
      UNION ALL SELECT 'missing_city', count(*) FROM m WHERE city IS NULL OR city = '' UNION ALL SELECT 'missing_coords', count(*) FROM m WHERE lat IS NULL
      UNION ALL SELECT 'complete_pct', round(count(lat) / count(*) * 100.0e0, 1) FROM m)
    SELECT metric, cast(value as decimal(18,1)) AS value FROM v""")
def run_report(t: Tables):
    merged = _merged(t)
    return quality.run_report(merged, snapshot.reconcile_published(_feed_rows(t)), snapshot.snapshot_diff(merged, t.view("old_snapshot"), active_keys=True))


# Catalogue rows of one period as a refresh takes them, and the three refreshes of the query below: rows that ordered
# early, then twice those that ordered late, so that what is gone is counted first and removed next.
_LOCATED = f"""SELECT c.slug, c.name, c.city, c.province, c.lat, c.lon, c.street, c.postcode, c.site, cast('active' as string) AS status, cast(0 as int) AS consecutive_missing, cast(NULL as date) AS first_seen,
    'https://{HOST}/' || c.slug AS official_url, c.id % 10 = 0 AS source_matches, CASE WHEN c.id % 50 = 0 THEN 'EUROPE' ELSE c.province END AS geo_province, a.first_order, a.last_order
    FROM {{catalog}} c JOIN {{activity}} a ON c.id = a.o_custkey"""


@query("refresh_report", f"""
    WITH l AS ({_LOCATED}), o AS (SELECT * FROM l WHERE first_order < timestamp '1997-01-01 00:00:00'), n AS (SELECT * FROM l WHERE last_order >= timestamp '2000-01-01 00:00:00'),
    u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE slug NOT IN (SELECT slug FROM n)),
    s AS (SELECT 2 AS v, * FROM u UNION ALL SELECT 3, * FROM n),
    r AS (SELECT v, 'site ' || regexp_replace(regexp_replace(site, '^https://', ''), '/$', '') AS detail, slug FROM s WHERE site IS NOT NULL
          UNION ALL SELECT v, 'address ' || lower(street) || '|' || replace(postcode, ' ', '') || '|' || lower(city), slug FROM s),
    f AS (SELECT v, 'geocoding_completeness' AS section, 'missing_coords' AS metric, slug AS key, NULL AS detail FROM (SELECT 2 AS v, * FROM u UNION ALL SELECT 3, * FROM u) WHERE lat IS NULL
      UNION ALL SELECT 2, 'diff', 'added', slug, NULL FROM n WHERE slug NOT IN (SELECT slug FROM o)
      UNION ALL SELECT 3, 'diff', 'removed', slug, NULL FROM o WHERE slug NOT IN (SELECT slug FROM n)
      UNION ALL SELECT v, 'sanity_checks', 'issue', slug, 'province mismatch' FROM n, (VALUES (2), (3)) w(v) WHERE geo_province <> province
      UNION ALL SELECT v, 'overrides_status', 'source_match', slug, NULL FROM n, (VALUES (2), (3)) w(v) WHERE source_matches
      UNION ALL SELECT v, 'reconciliation', 'excluded', slug, 'unpublished or startpage' FROM l, (VALUES (2), (3)) w(v) WHERE last_order < timestamp '2000-01-01 00:00:00'
      UNION ALL SELECT v, 'shared_resources_audit', 'warning', slug, detail FROM r WHERE (v, detail) IN (SELECT (v, detail) FROM r GROUP BY v, detail HAVING count(*) > 1)),
    k AS (SELECT count(*) AS active, (SELECT count(*) FROM u) AS processed, (SELECT count(lat) FROM u) AS complete, (SELECT count(*) FROM o) AS retained2 FROM n)
    SELECT v AS version, section, metric, key, detail, cast(NULL as double) AS value FROM f
    UNION ALL SELECT v, section, metric || '_count', NULL, NULL, count(*)::double FROM f GROUP BY ALL
    UNION ALL SELECT v, 'reconciliation', 'active_count', NULL, NULL, active::double FROM k, (VALUES (2), (3)) w(v)
    UNION ALL SELECT v, 'validation', 'is_valid', NULL, NULL, 1.0e0 FROM (VALUES (2), (3)) w(v)
    UNION ALL SELECT v, 'processed', 'processed_count', NULL, NULL, processed::double FROM k, (VALUES (2), (3)) w(v)
    UNION ALL SELECT v, 'geocoding_completeness', 'complete_count', NULL, NULL, complete::double FROM k, (VALUES (2), (3)) w(v)
    UNION ALL SELECT v, 'geocoding_completeness', 'percentage', NULL, NULL, round(complete::double / processed::double * 100.0e0, 1) FROM k, (VALUES (2), (3)) w(v)
    UNION ALL SELECT v, 'diff', 'retained_count', NULL, NULL, (CASE v WHEN 2 THEN retained2 ELSE active END)::double FROM k, (VALUES (2), (3)) w(v)""")
def refresh_report(t: Tables):
    from ..plans import jobs

    root = scratch_path(t.spark, "refresh")
    rows = t.sql(_LOCATED).withColumns({
        "official_urls": F.create_map(*[x for l in vocab.LOCALES for x in (F.lit(l), F.col("official_url"))]), "programmes": F.array(F.lit("default"))})
    # The orders are grouped once, not again for each part and each list of what was held back.
    rows = materialise(rows, "located")
    late = F.col("last_order") >= F.lit("2000-01-01").cast("timestamp")
    excluded = rows.select("slug", F.when(~late, "unpublished or startpage").alias("reason"))
    rules = quality.DatasetRules(min_rows=1, max_count_change_pct=1e9, min_complete_pct=80.0, max_turnover_pct=100.0)
    for i, part in enumerate((rows.where(F.col("first_order") < F.lit("1997-01-01").cast("timestamp")), rows.where(late), rows.where(late))):
        jobs.refresh(t.spark, part.drop("first_order", "last_order"), root, f"v{i + 1}", f"2001-09-0{i + 1}", HOST, rules, excluded=excluded)
    two, three = [publish.read_report(t.spark, root, f"v{i}").select(F.lit(i).alias("version"), "*") for i in (2, 3)]
    return two.unionByName(three)


@query("active_only", "SELECT slug, city FROM {catalog} WHERE status <> 'removed' AND duplicate_of IS NULL")
def active_only(t: Tables):
    return snapshot.active_only(t.view("catalog"), drop_duplicates_of=True).select("slug", "city")


@query("snapshot_fingerprint", """
    WITH h AS (SELECT cast('0x' || left(md5(concat_ws(chr(1), c_custkey, c_mktsegment, c_name, c_nationkey)), 12) as bigint) AS h FROM customer)
    SELECT count(*) AS row_count, bit_xor(h) AS hash_xor, cast(sum(h) as decimal(38,0)) AS hash_sum FROM h""")
def snapshot_fingerprint(t: Tables):
    return fingerprint(t.customer, ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"], portable=True)


@query("keep_last_per_key", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def keep_last_per_key(t: Tables):
    return documents.read_keyed(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("duplicate_keys", "SELECT cast(o_custkey as string) AS slug, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(t: Tables):
    return quality.duplicate_keys(t.orders.select(F.col("o_custkey").alias("slug")))


@query("completeness", """
    SELECT source, count(*) AS total, count(*) FILTER (WHERE quality IS NOT NULL AND text <> '') AS complete,
           round(count(*) FILTER (WHERE quality IS NOT NULL AND text <> '') / count(*) * 100.0e0, 1) AS pct
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def completeness(t: Tables):
    return quality.completeness(t.documents.join(t.labels, "doc_id", "left"), ["quality", "text"], ["source"])


@query("missing_fields", """
    SELECT slug, field FROM (SELECT slug, 'lat' AS field FROM {catalog} WHERE lat IS NULL UNION ALL SELECT slug, 'site' FROM {catalog} WHERE site IS NULL UNION ALL SELECT slug, 'city' FROM {catalog} WHERE city IS NULL)""")
def missing_fields(t: Tables):
    return quality.missing_fields(t.view("catalog"), ["lat", "site", "city"])


@query("validate_record", f"""
    WITH c AS (SELECT slug, CASE WHEN segment = 'furniture' THEN NULL ELSE name END AS name, CASE WHEN segment = 'machinery' THEN 'https://elsewhere.example.org/x' WHEN segment = 'building' THEN '' ELSE 'https://{HOST}/nl/' || slug END AS official_url,
                      CASE WHEN province = 'ASIA' THEN lat + 10 ELSE lat END AS lat, lon, segment FROM {{catalog}})
    SELECT slug, concat_ws('; ', CASE WHEN name IS NULL THEN 'Empty name: ' || slug END, CASE WHEN segment = 'building' THEN 'Missing official_url: ' || slug WHEN segment = 'machinery' THEN 'Invalid official_url host: ' || slug END,
           CASE WHEN segment = 'household' THEN 'Invalid official_urls[en] host: ' || slug END,
           CASE WHEN NOT (lat BETWEEN 50.70 AND 53.75 AND lon BETWEEN 3.20 AND 7.30) THEN 'Coordinates outside bounds: ' || slug END,
           CASE WHEN segment = 'automobile' THEN 'Invalid programmes: ' || slug END) AS errors FROM c""")
def validate_record(t: Tables):
    c, seg = t.view("catalog"), F.col("segment")
    urls = localized_urls(f"https://{HOST}", F.col("slug"))
    rows = c.select(
        "slug", F.when(seg != "furniture", F.col("name")).alias("name"),
        F.when(seg == "machinery", "https://elsewhere.example.org/x").when(seg == "building", "").otherwise(F.concat(F.lit(f"https://{HOST}/nl/"), "slug")).alias("official_url"),
        F.transform_values(urls, lambda k, v: F.when((k == "en") & (seg == "household"), "https://x.example.org/").otherwise(v)).alias("official_urls"),
        F.when(F.col("province") == "ASIA", F.col("lat") + 10).otherwise(F.col("lat")).alias("lat"), "lon",
        F.array(F.when(seg == "automobile", F.lit("")).otherwise("general")).alias("programmes"))
    return quality.validate_record(rows, HOST).select("slug", F.array_join("errors", "; ").alias("errors"))


_SHARED_ALLOWED = "SELECT 'site' AS kind, id AS group_id, slug, id FROM {catalog} WHERE segment = 'household'"


@query("shared_resource_audit", """
    WITH c AS (SELECT slug, 'www.' || segment || cast(id % 499 as string) || '.example.nl' AS resource, segment, id FROM {catalog} WHERE status <> 'removed' AND site IS NOT NULL),
    a AS (SELECT slug, lower('Street ' || cast(id % 977 as string) || 'b') || '|' || replace(postcode, ' ', '') || '|' || lower(city) AS resource FROM {catalog} WHERE status <> 'removed'),
    m AS (SELECT 'site' AS kind, resource, slug FROM c UNION ALL SELECT 'address', resource, slug FROM a),
    g AS (SELECT kind, resource, count(*) AS n_keys FROM m GROUP BY 1, 2 HAVING count(*) > 1),
    w AS (SELECT resource, count(*) AS n FROM (SELECT 'www.' || segment || cast(id % 499 as string) || '.example.nl' AS resource FROM {catalog} WHERE segment = 'household') GROUP BY 1)
    SELECT m.kind, m.resource, g.n_keys, m.slug FROM m JOIN g ON m.kind = g.kind AND m.resource = g.resource
    WHERE NOT (g.kind = 'site' AND g.resource LIKE 'www.household%' AND g.n_keys = coalesce((SELECT n FROM w WHERE w.resource = g.resource), -1))""")
def shared_resource_audit(t: Tables):
    rows = t.view("catalog").select("slug", "site", "street", "postcode", "city", "status", "segment", "id")
    allowed = rows.where("segment = 'household'").select(F.lit("site").alias("kind"), F.expr("id % 499").alias("group_id"), "slug")
    return quality.shared_resources(rows, allowed)


@query("apply_overrides", """
    WITH p AS (SELECT slug, name, city, province, id FROM {items}), o AS (
      SELECT slug, CASE WHEN id % 2 = 0 THEN upper(name) END AS name, CASE WHEN id % 3 = 0 THEN 'Moved' END AS acity, CASE WHEN id % 5 = 0 THEN province END AS province FROM {items} WHERE city IN ('Brand#1', 'Brand#2', 'Brand#3'))
    SELECT p.slug, coalesce(o.name, p.name) AS name, coalesce(o.acity, p.city) AS city, coalesce(o.province, p.province) AS province, coalesce(o.acity, p.city) AS address_city, 'main' AS address_street,
           o.slug IS NOT NULL AND (o.name IS NULL OR o.name = p.name) AND (o.acity IS NULL OR o.acity = p.city) AND (o.province IS NULL OR o.province = p.province) AS source_matches
    FROM p LEFT JOIN o ON p.slug = o.slug""")
def overrides(t: Tables):
    p = t.view("items").select("slug", "id", "name", "city", "province", F.struct(F.lit("main").alias("street"), F.col("city").alias("city")).alias("address"))
    o = p.where(F.col("city").isin("Brand#1", "Brand#2", "Brand#3")).select(
        "slug", F.when(F.col("id") % 2 == 0, F.upper("name")).alias("name"), F.when(F.col("id") % 5 == 0, F.col("province")).alias("province"),
        F.struct(F.when(F.col("id") % 3 == 0, F.lit("Moved")).alias("city")).alias("address"))
    return apply_overrides(p.drop("id"), o).select("slug", "name", "city", "province", F.col("address.city").alias("address_city"), F.col("address.street").alias("address_street"), "source_matches")


# --- stores -------------------------------------------------------------------------
# Results: one per order of a customer, in order-key sequence. Stored prices and review rows
# come from the catalogue; some stored prices are entered by hand.
_RESULTS = """
    SELECT 'c' || lpad(cast(o_custkey as string), 9, '0') AS slug, o_orderkey AS seq, o_orderpriority AS name, cast(cast(floor(o_totalprice) as bigint) / 100.0e0 as decimal(9,2)) AS price,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'manual' END AS entered_by, o_orderstatus <> 'F' AS is_accepted, o_orderstatus, o_orderpriority FROM {orders}"""
_PRICES = "SELECT slug, name, cast(1.00 as decimal(9,2)) AS price, CASE WHEN segment = 'furniture' THEN 'manual' END AS entered_by FROM {catalog} WHERE lat IS NOT NULL"
_REVIEW = "SELECT slug, name, cast(2.00 as decimal(9,2)) AS price FROM {catalog} WHERE segment = 'building'"


def _store_rows(prices, review, extra):
    return prices.select(F.lit("prices").alias("store"), "slug", "name", F.col("price").cast("string").alias("detail")).unionByName(
        review.select(F.lit("review").alias("store"), "slug", "name", extra.alias("detail")))


@query("record_results", f"""
    WITH r AS ({_RESULTS}), p AS ({_PRICES}), v AS ({_REVIEW}),
    k AS (SELECT slug, max(seq) FILTER (WHERE entered_by = 'manual' AND is_accepted) AS kept, max(seq) FILTER (WHERE entered_by = 'manual') AS man, max(seq) AS anyseq FROM r GROUP BY slug),
    s AS (SELECT k.slug, kept, (kept IS NOT NULL OR coalesce(p.entered_by = 'manual', false)) AS locked, CASE WHEN kept IS NOT NULL OR coalesce(p.entered_by = 'manual', false) THEN man ELSE anyseq END AS lastseq FROM k LEFT JOIN p ON k.slug = p.slug),
    l AS (SELECT s.slug, s.locked, s.kept, r.* EXCLUDE (slug) FROM s JOIN r ON r.slug = s.slug AND r.seq = s.lastseq),
    np AS (SELECT l.slug, r.name, r.price FROM l JOIN r ON r.slug = l.slug AND r.seq = CASE WHEN l.is_accepted THEN l.seq ELSE l.kept END),
    dropped AS (SELECT slug FROM l WHERE NOT is_accepted AND NOT locked)
    SELECT 'prices' AS store, slug, name, cast(price as string) AS detail FROM (SELECT slug, name, price FROM np UNION ALL SELECT slug, name, price FROM p WHERE slug NOT IN (SELECT slug FROM np) AND slug NOT IN (SELECT slug FROM dropped))
    UNION ALL SELECT 'review', slug, name, cast(price as string) FROM (SELECT slug, name, price FROM l WHERE NOT is_accepted UNION ALL SELECT slug, name, price FROM v WHERE slug NOT IN (SELECT slug FROM l))""")
def record_results(t: Tables):
    none = F.array().cast("array<string>")
    results = t.sql(_RESULTS).drop("o_orderstatus", "o_orderpriority").withColumn("failures", none)
    prices, review = stores.record_results(results, t.sql(_PRICES), t.sql(_REVIEW).withColumn("failures", none))
    return _store_rows(prices, review, F.col("price").cast("string"))


@query("save_agreed_results", f"""
    WITH r AS (SELECT *, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'retry_later' WHEN is_accepted THEN 'paid' ELSE 'needs_review' END AS status,
                      CASE WHEN is_accepted THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence,
                      CASE WHEN NOT is_accepted AND o_orderpriority <> '3-MEDIUM' THEN 'price_mismatch' END AS kind FROM ({_RESULTS})),
    p AS ({_PRICES}), v AS (SELECT slug, name, 'old' AS kind FROM ({_REVIEW})),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq DESC) AS rn FROM r WHERE status <> 'retry_later') WHERE rn = 1 AND slug NOT IN (SELECT slug FROM p WHERE entered_by = 'manual')),
    a AS (SELECT * FROM l WHERE is_accepted AND confidence IN ('high', 'medium')), j AS (SELECT * FROM l WHERE NOT (is_accepted AND confidence IN ('high', 'medium')))
    SELECT 'prices' AS store, slug, name, cast(price as string) AS detail FROM (SELECT slug, name, price FROM a UNION ALL SELECT slug, name, price FROM p WHERE slug NOT IN (SELECT slug FROM l))
    UNION ALL SELECT 'review', slug, name, kind FROM (SELECT slug, name, coalesce(kind, 'unknown_disagreement') AS kind FROM j UNION ALL SELECT slug, name, kind FROM v WHERE slug NOT IN (SELECT slug FROM l))""")
def save_agreed_results(t: Tables):
    prio = F.col("o_orderpriority")
    none = F.array().cast("array<string>")
    results = t.sql(_RESULTS).drop("entered_by").withColumns({
        "status": F.when(prio == "4-NOT SPECIFIED", "retry_later").when(F.col("is_accepted"), "paid").otherwise("needs_review"),
        "confidence": F.when(F.col("is_accepted") & (prio == "1-URGENT"), "high").when(F.col("is_accepted") & (prio == "2-HIGH"), "medium").otherwise("low"),
        "disagreement_type": F.when(~F.col("is_accepted") & (prio != "3-MEDIUM"), "price_mismatch"),
        "failures": none}).drop("o_orderstatus", "o_orderpriority")
    review = t.sql(_REVIEW).select("slug", "name", F.lit("old").alias("disagreement_type"), none.alias("failures"))
    prices, queue = stores.save_agreed(results, t.sql(_PRICES), review)
    return _store_rows(prices, queue, F.col("disagreement_type"))


@query("upsert_proposals", """
    WITH n AS (SELECT cast(o_custkey as string) AS slug, o_orderpriority AS field, o_orderstatus AS value, o_orderkey AS seq FROM orders),
    s AS (SELECT cast(c_custkey as string) AS slug, '1-URGENT' AS field, 'stored' AS value FROM customer),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, field ORDER BY seq DESC) AS rn FROM n) WHERE rn = 1)
    SELECT slug, field, value FROM l UNION ALL SELECT slug, field, value FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.slug = s.slug AND l.field = s.field)""")
def upsert_proposals(t: Tables):
    updates = t.orders.select(F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    store = t.customer.select(F.col("c_custkey").cast("string").alias("slug"), F.lit("1-URGENT").alias("field"), F.lit("stored").alias("value"))
    return stores.upsert_latest(store, updates, ["slug", "field"])


@query("clear_proposals", """
    SELECT o_orderpriority = '5-LOW' AS removed, count(*) AS n FROM orders GROUP BY 1""")
def clear_proposals(t: Tables):
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("field"))
    return stores.clear_matching(rows, slug=None, field="5-LOW").groupBy("removed").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_typed", """
    WITH r AS (SELECT * FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'n/a' ELSE '4.5' END AS rating, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE cast(o_orderkey % 1000 as string) END AS reviews,
                              row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
    SELECT cast(o_custkey as string) AS slug, coalesce(c_name, cast(o_custkey as string)) AS name, try_cast(rating as double) AS rating, coalesce(try_cast(reviews as int), 0) AS reviews_count, 'Google' AS source
    FROM r LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey""")
def upsert_typed(t: Tables):
    status = F.col("o_orderstatus")
    raw = t.orders.select(F.col("o_custkey").cast("string").alias("slug"), F.when(status == "F", "n/a").when(status == "O", "4.5").alias("rating"),
                          F.when(status != "F", (F.col("o_orderkey") % 1000).cast("string")).alias("reviews_count"), F.col("o_orderkey").alias("seq"))
    names = t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("name"))
    typed = stores.typed_rating(raw, names)
    return stores.upsert_latest(typed.drop("seq").limit(0), typed, ["slug"])


@query("allowed_or_default", """
    WITH n AS (SELECT slug, CASE WHEN name LIKE '%ring%' THEN 'kunst' WHEN name LIKE '%rod%' THEN 'natuur,zee' WHEN name LIKE '%gear%' THEN 'auto' ELSE '' END AS c FROM {items} WHERE province <> 'PROMO'),
    s AS (SELECT slug FROM {items} WHERE province IN ('PROMO', 'SMALL'))
    SELECT slug, CASE c WHEN 'kunst' THEN 'kunst' WHEN 'natuur,zee' THEN 'natuur' ELSE 'geschiedenis' END AS categories FROM n WHERE slug NOT IN (SELECT slug FROM s) UNION ALL SELECT slug, 'stored' FROM s""")
def allowed_or_default(t: Tables):
    items = t.view("items")
    raw = F.when(F.col("name").contains("ring"), "kunst").when(F.col("name").contains("rod"), "natuur,zee").when(F.col("name").contains("gear"), "auto").otherwise("")
    fresh = items.where("province <> 'PROMO'").select("slug", F.array_join(stores.allowed_or_default(F.split(raw, ",")), ",").alias("categories"))
    store = items.where("province in ('PROMO', 'SMALL')").select("slug", F.lit("stored").alias("categories"))
    return stores.add_new(store, fresh)


# --- reports ------------------------------------------------------------------------

@query("status_report", """
    WITH p AS (SELECT CASE WHEN status = 'paid' OR coalesce(price, 0) <> 0 THEN 'paid' WHEN status IN ('free', 'closed') THEN status ELSE 'other' END AS status_class, price FROM {prices})
    SELECT status_class, count(*) AS n, cast(round(sum(CASE WHEN status_class = 'paid' THEN price END) / count(CASE WHEN status_class = 'paid' THEN price END), 2) as decimal(18,2)) AS avg_price,
           min(CASE WHEN status_class = 'paid' THEN price END) AS min_price, max(CASE WHEN status_class = 'paid' THEN price END) AS max_price FROM p GROUP BY 1""")
def status_report(t: Tables):
    return audit.status_report(t.view("prices").select("status", "price"))


@query("failure_histogram", """
    WITH r AS (SELECT l_returnflag AS v, l_linestatus AS s, CASE WHEN l_quantity > 45 THEN 'Literal match gate: Quote was NOT FOUND VERBATIM' END AS f1, CASE WHEN l_discount > 0.08 THEN 'Range gate: too high' END AS f2,
                      CASE WHEN l_tax > 0.07 THEN 'Combo rejection gate: word' END AS f3 FROM lineitem),
    e AS (SELECT 'literal_quote_mismatch' AS reason FROM r WHERE f1 IS NOT NULL UNION ALL SELECT 'range_out_of_bounds' FROM r WHERE f2 IS NOT NULL UNION ALL SELECT 'combo_ticket_rejected' FROM r WHERE f3 IS NOT NULL
          UNION ALL SELECT CASE WHEN v = 'R' THEN 'verifier_rejected' WHEN s = 'F' THEN 'bot_protection' ELSE 'unspecified_review' END FROM r WHERE f1 IS NULL AND f2 IS NULL AND f3 IS NULL)
    SELECT reason, count(*) AS n FROM e GROUP BY 1""")
def failure_histogram(t: Tables):
    rows = t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", "reject").alias("verdict"), F.when(F.col("l_linestatus") == "F", "blocked_by_bot_protection").alias("status"),
        F.array_compact(F.array(F.when(F.col("l_quantity") > 45, F.lit("Literal match gate: Quote was NOT FOUND VERBATIM")), F.when(F.col("l_discount") > 0.08, F.lit("Range gate: too high")),
                                F.when(F.col("l_tax") > 0.07, F.lit("Combo rejection gate: word")))).alias("failures"))
    return audit.failure_histogram(rows)


@query("run_summary", """
    WITH r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'free' WHEN '2-HIGH' THEN 'closed' WHEN '5-LOW' THEN 'blocked_by_bot_protection' ELSE 'paid' END AS st, o_orderstatus = 'O' AS ok,
                      CASE WHEN o_orderstatus = 'F' THEN 'price_mismatch' END AS kind, o_orderpriority FROM orders),
    s AS (SELECT CASE WHEN NOT ok AND o_orderpriority = '4-NOT SPECIFIED' THEN 'retry_later' WHEN NOT ok AND o_orderpriority = '3-MEDIUM' THEN 'quota_exhausted' ELSE st END AS st, ok, kind FROM r)
    SELECT 'total_processed' AS metric, count(*) AS n FROM s UNION ALL SELECT 'accepted_total', count(*) FROM s WHERE ok
    UNION ALL SELECT 'accepted_' || CASE st WHEN 'blocked_by_bot_protection' THEN 'blocked' ELSE st END, count(*) FROM s WHERE ok GROUP BY 1
    UNION ALL SELECT 'needs_review_total', count(*) FROM s WHERE NOT ok AND st NOT IN ('retry_later', 'quota_exhausted')
    UNION ALL SELECT 'needs_review_' || coalesce(kind, 'unknown'), count(*) FROM s WHERE NOT ok AND st NOT IN ('retry_later', 'quota_exhausted') GROUP BY 1
    UNION ALL SELECT 'retry_later_total', count(*) FROM s WHERE st = 'retry_later' UNION ALL SELECT 'quota_exhausted_total', count(*) FROM s WHERE st = 'quota_exhausted'""")
def run_summary(t: Tables):
    prio, ok = F.col("o_orderpriority"), F.col("o_orderstatus") == "O"
    status = (F.when(~ok & (prio == "4-NOT SPECIFIED"), "retry_later").when(~ok & (prio == "3-MEDIUM"), "quota_exhausted").when(prio == "1-URGENT", "free")
              .when(prio == "2-HIGH", "closed").when(prio == "5-LOW", "blocked_by_bot_protection").otherwise("paid"))
    return audit.run_summary(t.orders.select(status.alias("status"), ok.alias("is_accepted"), F.when(F.col("o_orderstatus") == "F", "price_mismatch").alias("disagreement_type")))


@query("mode_comparison", """
    WITH r AS (SELECT l_linestatus AS mode, l_returnflag = 'N' AS ok, l_linenumber AS calls, cast(l_quantity as decimal(9,2)) AS seconds FROM lineitem),
    m AS (SELECT mode, count(*)::double AS total, count(*) FILTER (WHERE ok)::double AS accepted, count(*) FILTER (WHERE NOT ok)::double AS needs_review, sum(calls)::double AS calls, round(sum(calls)::double / count(*), 2) AS avg_calls,
                 sum(seconds)::double AS seconds, round(sum(seconds)::double / count(*), 2) AS avg_seconds FROM r GROUP BY 1),
    l AS (UNPIVOT m ON total, accepted, needs_review, calls, avg_calls, seconds, avg_seconds INTO NAME metric VALUE value)
    SELECT metric, cast(max(value) FILTER (WHERE mode = 'F') as decimal(18,2)) AS "F", cast(max(value) FILTER (WHERE mode = 'O') as decimal(18,2)) AS "O" FROM l GROUP BY 1""")
def mode_comparison(t: Tables):
    runs = t.lineitem.select(F.col("l_linestatus").alias("mode"), (F.col("l_returnflag") == "N").alias("is_accepted"), F.col("l_linenumber").alias("calls"), F.col("l_quantity").cast("decimal(9,2)").alias("seconds"))
    return audit.mode_comparison(runs, ["F", "O"])


_CASES = """SELECT lang AS cohort, CASE WHEN quality = 0 THEN 'wrong' ELSE 'correct' END AS category, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'child_price' WHEN source IN ('src4', 'src5') THEN 'group_rate' ELSE 'other' END AS subtype,
    n_chars % 3 <> 0 AS gates_passed, CASE n_chars % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'unsure' ELSE 'confirm' END AS verdict FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""


def _wilson_sql(k: str, n: str, name: str) -> str:
    z2 = "3.8414588206941254e0"
    c = f"(({k}::double / {n} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    m = f"((1.959963984540054e0 / (1 + {z2} / {n})) * sqrt(({k}::double / {n}) * (1 - {k}::double / {n}) / {n} + {z2} / (4e0 * {n} * {n})))"
    return (f"CASE WHEN {n} > 0 THEN round({k} / {n} * 100.0e0, 1) ELSE 0e0 END AS {name}_pct, CASE WHEN {n} > 0 THEN round(greatest(0e0, {c} - {m}) * 100, 1) ELSE 0e0 END AS {name}_low, "
            f"CASE WHEN {n} > 0 THEN round(least(1e0, {c} + {m}) * 100, 1) ELSE 100e0 END AS {name}_high")


@query("cohort_metrics", f"""
    WITH c AS ({_CASES}), f AS (SELECT *, category = 'wrong' AS w, gates_passed AND verdict = 'confirm' AS ok, verdict <> 'confirm' AS caught FROM c),
    g AS (SELECT coalesce(cohort, 'combined') AS cohort, count(*) AS total_cases, count(*) FILTER (WHERE w) AS wrong_count, count(*) FILTER (WHERE w AND NOT ok) AS wrong_rejected, count(*) FILTER (WHERE NOT w) AS correct_count,
                 count(*) FILTER (WHERE NOT w AND ok) AS correct_confirmed, count(*) FILTER (WHERE w AND subtype <> 'other') AS semantic_count, count(*) FILTER (WHERE w AND subtype <> 'other' AND caught) AS semantic_rejected,
                 count(*) FILTER (WHERE w AND NOT gates_passed) AS gate_catches, count(*) FILTER (WHERE w AND caught) AS verifier_catches FROM f GROUP BY ROLLUP (cohort))
    SELECT *, {_wilson_sql('wrong_rejected', 'wrong_count', 'rejection')}, {_wilson_sql('correct_confirmed', 'correct_count', 'confirm')}, {_wilson_sql('semantic_rejected', 'semantic_count', 'semantic')} FROM g""")
def cohort_metrics(t: Tables):
    return audit.cohort_metrics(t.sql(_CASES))


@query("audit_sample", """
    SELECT slug, price_status AS status, price, cast(coalesce(nullif(price, 0), 9999) as decimal(9,2)) AS sort_price FROM {items} WHERE price_status = 'paid' OR coalesce(price, 0) > 0 ORDER BY md5('7|' || slug), slug LIMIT 100""")
def audit_sample(t: Tables):
    return audit.audit_sample(t.view("items").select("slug", F.col("price_status").alias("status"), "price"), 100, "7", paid=True)
