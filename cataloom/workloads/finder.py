"""Catalogue view, search, geo joins and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as price_fn
from ..operators import catalog as cat
from ..operators import geo_join, propose, quality
from ..operators.scale import rank_rows
from ..plans.jobs import Finder
from .registry import Tables, query

_KM = "6371.0e0 * 2 * atan2(sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)), sqrt(1 - (pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2))))"
# Gazetteer of places: one per supplier.
_PLACES = """SELECT s_suppkey AS pos, s_name AS place, s_name AS name, n_name AS province, 50.8e0 + (s_suppkey * 7927 % 2900) / 1000.0e0 AS lat, 3.3e0 + (s_suppkey * 104759 % 3900) / 1000.0e0 AS lon FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


def _points(t: Tables):
    return t.view("catalog").select("slug", "lat", "lon")


@query("nearest_place", f"""
    WITH p AS ({_PLACES}), d AS (SELECT c.slug, p.place, p.pos, {_KM} AS km FROM {{catalog}} c JOIN p ON c.lat IS NOT NULL)
    SELECT slug, place, round(dist_km, 6) AS dist_km FROM (SELECT slug, place, km AS dist_km, row_number() OVER (PARTITION BY slug ORDER BY km, pos) AS rn FROM d) WHERE rn = 1
    UNION ALL SELECT slug, NULL, NULL FROM {{catalog}} WHERE lat IS NULL""")
def nearest_place(t: Tables):
    near = geo_join.nearest_place(_points(t), t.sql(_PLACES).select("pos", "place", "lat", "lon"))
    return near.select("slug", "place", F.round("dist_km", 6).alias("dist_km"))


@query("radius_join", f"WITH p AS ({_PLACES}) SELECT slug, place, round(km, 6) AS dist_km FROM (SELECT c.slug, p.place, {_KM} AS km FROM {{catalog}} c JOIN p ON c.lat IS NOT NULL) WHERE km <= 25")
def radius_join(t: Tables):
    near = geo_join.radius_join(_points(t), t.sql(_PLACES).select("place", "lat", "lon"), 25.0)
    return near.select("slug", "place", F.round("dist_km", 6).alias("dist_km"))


@query("resolve_place", f"""
    WITH p AS ({_PLACES}), q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN ' SUPPLIÉR#' || lpad(cast(c_custkey % 150 as string), 9, '0') WHEN c_custkey % 3 = 1 THEN 'Supplier#0000000' || cast(c_custkey % 20 as string) ELSE 'su' END AS query FROM customer),
    f AS (SELECT id, query, trim(lower(strip_accents(query))) AS k FROM q),
    m AS (SELECT f.id, f.query, p.name, p.province, row_number() OVER (PARTITION BY f.id ORDER BY (lower(p.name) = f.k) DESC, p.pos) AS rn FROM f JOIN p ON lower(p.name) = f.k OR (length(f.k) >= 3 AND starts_with(lower(p.name), f.k)))
    SELECT f.id, f.query, m.name, m.province FROM f LEFT JOIN m ON f.id = m.id AND rn = 1""")
def resolve_place(t: Tables):
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit(" SUPPLIÉR#"), F.lpad((k % 150).cast("string"), 9, "0"))).when(k % 3 == 1, F.concat(F.lit("Supplier#0000000"), (k % 20).cast("string"))).otherwise("su")
    return geo_join.resolve_place(t.customer.select(k.alias("id"), asked.alias("query")), t.sql(_PLACES)).select("id", "query", "name", "province")


@query("cache_join", """
    SELECT c.slug, c.segment <> 'machinery' AND c.lat IS NOT NULL AND c.province <> 'ASIA' AS cache_hit, CASE WHEN c.segment <> 'machinery' AND c.lat IS NOT NULL AND c.province <> 'ASIA' THEN CASE WHEN c.segment = 'building' THEN 'w' ELSE c.city END END AS place FROM {catalog} c""")
def cache_join(t: Tables):
    c = t.view("catalog")
    sig = F.concat_ws("|", "postcode", "street", F.coalesce("city", F.lit("")))
    cache = c.select("slug", F.when(F.col("segment") == "machinery", "moved").otherwise(sig).alias("address_sig"), F.when(F.col("province") != "ASIA", F.col("lat")).alias("lat"), "lon",
                     F.when(F.col("segment") == "building", "").otherwise(F.col("city")).alias("city"), F.lit("w").alias("woonplaats"))
    return geo_join.cache_join(c.drop("lat", "lon"), cache).select("slug", "cache_hit", "place")


# Geocoder answers: some by postcode and number, some by street and city, some by name.
def _gazetteer(t: Tables):
    c, seg = t.view("catalog"), F.col("segment")
    number = F.regexp_extract("street", r"(\d+\w*)", 1)
    asked = (F.when(seg == "building", F.concat_ws(" ", "postcode", number)).when(seg == "machinery", F.concat_ws(", ", "street", "city"))
             .when(seg == "furniture", F.concat_ws(" ", "postcode", "city")).when(seg == "household", F.concat_ws(", ", "name", "city")).otherwise("nowhere"))
    rows = c.where("lat is not null").select(asked.alias("query"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), F.col("id"), F.col("lat").alias("y"), "lon", "city", "province", "segment")
    good = (F.col("pos") == 2)
    return rows.select("query", "pos", F.when(good, "adres").otherwise("weg").alias("type"), F.when(good & (F.col("province") != "ASIA"), F.col("y")).otherwise(10.0).alias("lat"), "lon",
                       F.when(F.col("segment") == "furniture", "").otherwise(F.upper("city")).alias("woonplaats"), F.lit(None).cast("string").alias("municipality"), F.col("province"), "id")


_LADDER = """
    WITH c AS (SELECT *, regexp_extract(street, '(\\d+\\w*)', 1) AS num FROM {catalog}),
    g AS (SELECT CASE segment WHEN 'building' THEN postcode || ' ' || num WHEN 'machinery' THEN street || ', ' || city WHEN 'furniture' THEN postcode || ' ' || city WHEN 'household' THEN name || ', ' || city ELSE 'nowhere' END AS query, CASE WHEN province <> 'ASIA' THEN lat ELSE 10.0e0 END AS lat, lon,
                 CASE WHEN segment = 'furniture' THEN '' ELSE upper(city) END AS woonplaats, province, id FROM c WHERE lat IS NOT NULL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY lat DESC, id) AS rn FROM g) WHERE rn = 1),
    q AS (SELECT slug, 1 AS tier, postcode || ' ' || num AS query FROM c UNION ALL SELECT slug, 2, street || ', ' || city FROM c UNION ALL SELECT slug, 3, postcode || ' ' || city FROM c UNION ALL SELECT slug, 4, name || ', ' || city FROM c),
    h AS (SELECT q.slug, tier, q.query, lat, woonplaats, row_number() OVER (PARTITION BY slug ORDER BY tier) AS rn FROM q JOIN b ON b.query = q.query WHERE lat BETWEEN 50.70 AND 53.75)"""


def _ladder(t: Tables):
    # Equal queries occur when a street or postcode repeats; the answer with the greatest
    # latitude is listed first, as in the SQL.
    gaz = _gazetteer(t).withColumn("pos", F.struct((-F.col("lat")).alias("a"), F.col("id").alias("b"))).drop("id")
    places = t.view("catalog").select("slug", "name", "street", "postcode", "city", "province")
    return places, geo_join.match_ladder(places, gaz)


@query("match_ladder", _LADDER + " SELECT c.slug, cast(h.tier as int) AS tier, h.query, round(h.lat, 6) AS lat FROM c LEFT JOIN h ON c.slug = h.slug AND h.rn = 1")
def match_ladder(t: Tables):
    _, hits = _ladder(t)
    return hits.select("slug", "tier", "query", F.round("lat", 6).alias("lat"))


@query("geo_enrich", _LADDER + """ SELECT c.slug, c.city, CASE WHEN h.lat IS NOT NULL THEN coalesce(nullif(h.woonplaats, ''), c.city) ELSE c.city END AS woonplaats, CASE WHEN h.lat IS NOT NULL THEN coalesce(nullif(h.woonplaats, ''), c.city) END AS municipality
    FROM c LEFT JOIN h ON c.slug = h.slug AND h.rn = 1""")
def geo_enrich(t: Tables):
    places, hits = _ladder(t)
    return geo_join.geo_enrich(places, hits).select("slug", "city", "woonplaats", "municipality")


@query("geo_sanity", """
    WITH c AS (SELECT slug, province, CASE segment WHEN 'building' THEN ' ' || lower(province) WHEN 'machinery' THEN 'Fryslân' WHEN 'furniture' THEN NULL ELSE province END AS geo_province, lat + CASE WHEN segment = 'household' THEN 5 ELSE 0 END AS lat, lon, segment FROM {catalog})
    SELECT slug, concat_ws(',', CASE WHEN segment = 'machinery' THEN 'province mismatch' END, CASE WHEN segment = 'household' AND lat IS NOT NULL THEN 'coordinate outlier' END) AS issues, segment = 'household' AS is_outlier
    FROM c WHERE segment = 'machinery' OR (segment = 'household' AND lat IS NOT NULL)""")
def geo_sanity(t: Tables):
    seg, province = F.col("segment"), F.col("province")
    rows = t.view("catalog").select("slug", "province", F.when(seg == "building", F.concat(F.lit(" "), F.lower(province))).when(seg == "machinery", "Fryslân").when(seg != "furniture", province).alias("geo_province"),
                                    F.when(seg == "household", F.col("lat") + 5).otherwise(F.col("lat")).alias("lat"), "lon")
    return geo_join.geo_sanity(rows).select("slug", F.array_join("issues", ",").alias("issues"), "is_outlier")


# --- view and finder ----------------------------------------------------------------

def _view(t: Tables, keep_duplicates: bool = True):
    c = t.view("catalog").select("slug", "name", "city", "province", "lat", "lon", "status", "duplicate_of", "segment")
    text = t.view("prices").where("n_orders > 8").select("slug", F.array("status").alias("categories"))
    return cat.catalog_view(c, t.view("prices"), text, t.view("ratings"), keep_duplicates)


@query("catalog_view", """
    WITH s AS (SELECT p.slug, status, price, CASE WHEN n_orders > 8 THEN status END AS categories, rating, reviews FROM {prices} p LEFT JOIN {ratings} r ON p.slug = r.slug),
    c AS (SELECT slug, duplicate_of FROM {catalog} WHERE status <> 'removed')
    SELECT c.slug, coalesce(a.status, b.status, 'unknown') AS price_status, cast(CASE coalesce(a.status, b.status) WHEN 'free' THEN 0 WHEN 'paid' THEN CASE WHEN a.slug IS NOT NULL THEN a.price ELSE b.price END END as decimal(9,2)) AS price,
           coalesce(a.categories, b.categories, '') AS categories, CASE WHEN a.rating IS NOT NULL THEN a.rating ELSE b.rating END AS rating, coalesce(CASE WHEN a.rating IS NOT NULL THEN a.reviews ELSE b.reviews END, 0) AS reviews
    FROM c LEFT JOIN s a ON c.slug = a.slug LEFT JOIN s b ON c.duplicate_of = b.slug""")
def catalog_view(t: Tables):
    return _view(t).select("slug", "price_status", "price", F.array_join("categories", ",").alias("categories"), "rating", "reviews")


@query("canonicalise", "SELECT i.o_orderkey AS pos, cast(i.o_custkey as string) AS owner, coalesce(c.duplicate_of, 'c' || lpad(cast(i.o_custkey as string), 9, '0')) AS item FROM orders i LEFT JOIN {catalog} c ON c.slug = 'c' || lpad(cast(i.o_custkey as string), 9, '0') AND c.duplicate_of IS NOT NULL")
def canonicalise(t: Tables):
    item = F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    rows = t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("owner"), item.alias("item"))
    return cat.canonicalise(rows, t.view("catalog"), "item")


@query("search_catalog", "SELECT slug, name, city FROM {catalog} WHERE lower(name) LIKE '%nation_7%' OR lower(city) LIKE '%nation_7%' OR lower(city) LIKE '%nation_1%' OR lower(name) LIKE '%nation_1%' OR lower(province) LIKE '%nation_7%' OR lower(street) LIKE '%nation_7%' OR lower(postcode) LIKE '%nation_7%'")
def search_catalog(t: Tables):
    rows = cat.with_search_columns(t.view("catalog"))
    return cat.search(rows, "  Nátion_7 ", {"NATION_7": "Nation_1"}).select("slug", "name", "city")


@query("facet_filter", "SELECT slug FROM {items} WHERE province = 'PROMO' AND city <> 'x' AND (name LIKE 'red%' OR name LIKE 'blue%') AND NOT reviews > 60")
def facet_filter(t: Tables):
    rows = t.view("items").withColumn("categories", F.split("name", " ")).withColumn("visited", F.col("reviews") > 60)
    return cat.facet_filter(rows, province="PROMO", categories=("red", "blue"), hide_visited=True).select("slug")


@query("price_band", """
    SELECT slug, CASE WHEN price_status = 'free' OR price = 0 THEN 'free' WHEN price > 0 AND price < 10 THEN 'under-10' WHEN price >= 10 AND price < 15 THEN '10-15' WHEN price >= 15 AND price < 20 THEN '15-20' WHEN price >= 20 THEN '20-plus' END AS band FROM {items}""")
def price_band(t: Tables):
    return t.view("items").select("slug", price_fn.price_band(F.col("price_status"), F.col("price")).alias("band"))


@query("min_score_filter", "SELECT slug, rating, reviews FROM {items} WHERE rating >= 4.5 AND reviews >= 40")
def min_score_filter(t: Tables):
    return cat.min_score(t.view("items"), 4.5, 40).select("slug", "rating", "reviews")


@query("sort_catalog", """
    SELECT slug, row_number() OVER (ORDER BY rating DESC NULLS LAST, CASE WHEN rating IS NOT NULL THEN reviews END DESC NULLS LAST, price ASC NULLS LAST, lower(name), name, slug) AS rank FROM {items}""")
def sort_catalog(t: Tables):
    return rank_rows(t.view("items"), cat.sort_order("rating-desc", "price-asc")).select("slug", "rank")


@query("finder", f"""
    SELECT c.slug, round(km, 6) AS distance, price FROM (SELECT c.slug, {_KM.replace('p.lat', '52.0e0').replace('p.lon', '5.0e0')} AS km, coalesce(p.status, 'unknown') AS st, CASE p.status WHEN 'free' THEN cast(0 as decimal(9,2)) WHEN 'paid' THEN p.price END AS price, c.city
      FROM {{catalog}} c LEFT JOIN {{prices}} p ON c.slug = p.slug WHERE c.status <> 'removed' AND c.duplicate_of IS NULL) c WHERE km <= 100 AND price >= 10 AND price < 15 AND lower(city) LIKE '%nation%'""")
def finder(t: Tables):
    found = Finder(query="nation", at=(52.0, 5.0), max_km=100.0, band="10-15", sort="distance", then="price-asc").run(_view(t, False))
    return found.select("slug", F.round("distance", 6).alias("distance"), "price")


@query("facet_values", "SELECT DISTINCT 'province' AS facet, province AS value FROM {items} UNION SELECT DISTINCT 'city', city FROM {items}")
def facet_values(t: Tables):
    return cat.facet_values(t.view("items"), ["province", "city"])


@query("city_centroids", "SELECT city, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM {catalog} WHERE lat IS NOT NULL GROUP BY city")
def city_centroids(t: Tables):
    return cat.city_centroids(t.view("catalog"))


@query("visible_extent", """
    SELECT count(*) AS total, count(*) FILTER (WHERE v) AS shown, round(min(CASE WHEN v THEN lat END), 6) AS min_lat, round(max(CASE WHEN v THEN lat END), 6) AS max_lat, round(min(CASE WHEN v THEN lon END), 6) AS min_lon, round(max(CASE WHEN v THEN lon END), 6) AS max_lon, count(*) FILTER (WHERE v) = count(*) AS default_view
    FROM (SELECT lat, lon, lat IS NOT NULL AND province = 'EUROPE' AS v FROM {catalog})""")
def visible_extent(t: Tables):
    out = cat.visible_extent(t.view("catalog"), F.col("province") == "EUROPE")
    return out.withColumns({c: F.round(c, 6) for c in ("min_lat", "max_lat", "min_lon", "max_lon")})


@query("result_count", "SELECT count(*) FILTER (WHERE name LIKE '%ring%' AND NOT reviews > 60) AS visible, count(*) FILTER (WHERE reviews > 60) AS hidden_visited, count(*) FILTER (WHERE name LIKE '%ring%' AND NOT reviews > 60) = 0 AS not_found FROM {items}")
def result_count(t: Tables):
    rows = t.view("items").withColumn("visited", F.col("reviews") > 60)
    return cat.result_count(rows, F.col("name").contains("ring") & ~F.col("visited"), hide_visited=True)


@query("locale_routes", "SELECT DISTINCT l AS lang, r AS route, slug AS target FROM (SELECT s_name AS slug, unnest([s_name, lower(s_name)]) AS r FROM supplier WHERE s_acctbal >= 0), (VALUES ('nl'), ('en'), ('uk')) v(l)")
def locale_routes(t: Tables):
    return cat.locale_routes(t.supplier.select(F.col("s_name").alias("slug"), F.when(F.col("s_acctbal") < 0, "removed").alias("status")))


@query("select_by_keys", "SELECT event_id AS pos, c_custkey AS slug, c_name FROM events JOIN customer ON user_id * 11 = c_custkey")
def select_by_keys(t: Tables):
    wanted = t.events.select((F.col("user_id") * 11).alias("slug"), F.col("event_id").alias("pos"))
    return cat.select_by_keys(t.customer.select(F.col("c_custkey").alias("slug"), "c_name"), wanted)


@query("pending_anti_join", "SELECT slug FROM {catalog} WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def pending_anti_join(t: Tables):
    done = t.orders.where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("id"))
    return cat.pending(t.view("catalog"), done, "id").select("slug")


@query("missing_targets", "SELECT slug, site IS NULL AS missing FROM {catalog}")
def missing_targets(t: Tables):
    c = t.view("catalog").select("slug", "site")
    return cat.missing_targets(c, "site").select("slug", F.lit(True).alias("missing")).unionByName(cat.missing_targets(c, "site", False).select("slug", F.lit(False).alias("missing")))


@query("limit_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def limit_n(t: Tables):
    return cat.limit_n(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50)


@query("field_discrepancy", """
    WITH l AS (SELECT l_orderkey AS k, cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(18,2)) AS v FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, cast(o_totalprice as decimal(18,2)) AS v FROM orders)
    SELECT o.k AS o_orderkey, o.v AS current_value, l.v AS proposed_value FROM o JOIN l ON o.k = l.k WHERE abs(o.v - l.v) > 0.01""")
def field_discrepancy(t: Tables):
    left = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    right = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(18,2)").alias("v"))
    return propose.field_discrepancy(left, right, "o_orderkey", "v")
