import json
import math
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cataloom.functions import vocab
from cataloom.operators import agreement, audit, catalog as cat, contact, gates, geo_join, links, lists, mining, overrides, propose, quality, recheck, snapshot, stores
from cataloom.operators.scale import rank_rows, top_per_key
from cataloom.plans import jobs
from cataloom.sources import documents, publish

CATALOG = "slug string, name string, city string, lat double, lon double, status string, consecutive_missing int, first_seen date"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def catalog(spark, slugs, status="active", missing=0, city="X", lat=52.0, lon=5.0):
    return spark.createDataFrame([(s, s, city, lat, lon, status, missing, None) for s in slugs], CATALOG)


# --- snapshots ------------------------------------------------------------------------

def test_diff(spark):
    got = dict(rows_of(snapshot.snapshot_diff(catalog(spark, "bc"), catalog(spark, "ab"))))
    assert got == {"c": "added", "a": "removed", "b": "retained"}


def test_soft_delete_over_three_runs(spark):
    first = catalog(spark, "ab")
    state = lambda df: {r.slug: (r.status, r.consecutive_missing) for r in df.collect()}
    second = snapshot.soft_delete_merge(catalog(spark, "a"), first)
    assert state(second)["b"] == ("active", 1)
    third = snapshot.soft_delete_merge(catalog(spark, "a"), second)
    assert state(third)["b"] == ("removed", 2)
    assert dict(rows_of(snapshot.snapshot_diff(third, second, active_keys=True)))["b"] == "removed"
    back = snapshot.soft_delete_merge(catalog(spark, "ab"), third, as_of="2026-01-01")
    assert state(back)["b"] == ("active", 0)
    assert dict(rows_of(snapshot.snapshot_diff(back, third, active_keys=True)))["b"] == "restored"


def test_first_seen_is_carried(spark):
    old = catalog(spark, "a").withColumn("first_seen", F.lit("2020-02-02").cast("date"))
    got = snapshot.soft_delete_merge(catalog(spark, "ab"), old, as_of="2026-01-01").collect()
    assert {r.slug: str(r.first_seen) for r in got} == {"a": "2020-02-02", "b": "2026-01-01"}


def test_dataset_rules(spark):
    names = [f"m{i}" for i in range(195)]
    verdict = lambda new, old=None: quality.dataset_verdict(new, old).first()
    assert verdict(catalog(spark, names)).is_valid
    assert verdict(catalog(spark, names[:50])).failed_rules == ["min_count", "count_change"]
    bare = catalog(spark, names[:20], lat=None).unionByName(catalog(spark, names[20:]))
    assert verdict(bare).failed_rules == ["completeness"]
    assert verdict(catalog(spark, names + names[:1])).failed_rules == ["key_uniqueness"]
    moved = catalog(spark, names[30:] + [f"n{i}" for i in range(30)])
    assert verdict(moved, catalog(spark, names)).failed_rules == ["turnover_added", "turnover_removed"]


def test_refresh_publishes_once_and_keeps_data_on_failure(spark, tmp_path):
    root, names = str(tmp_path / "store"), [f"m{i}" for i in range(120)]
    host = "h.nl"

    def rows(slugs):
        url = F.concat(F.lit(f"https://{host}/"), "slug")
        return catalog(spark, slugs).withColumns({
            "official_url": url, "official_urls": F.create_map(*[x for l in vocab.LOCALES for x in (F.lit(l), url)]), "programmes": F.array(F.lit("p"))})

    rules = quality.DatasetRules(baseline_rows=120)
    jobs.refresh(spark, rows(names), root, "v1", "2026-01-01", host, rules)
    jobs.refresh(spark, rows(names), root, "v2", "2026-01-02", host, rules)
    assert publish.current_version(spark, root) == "v1"
    with pytest.raises(jobs.RefreshRejected):
        jobs.refresh(spark, rows([f"other{i}" for i in range(5)]).withColumn("city", F.lit("")), root, "v3", "2026-01-03", host, quality.DatasetRules(baseline_rows=120, max_turnover_pct=1.0))
    assert publish.current_version(spark, root) == "v1" and publish.read_published(spark, root).count() == 120
    jobs.refresh(spark, rows(names + ["new"]), root, "v4", "2026-01-04", host, rules)
    assert publish.current_version(spark, root) == "v4"
    assert [r.added for r in publish.read_changelog(spark, root).collect()] == [1, 120]
    told = {(r.metric, r.key): r.value for r in publish.read_report(spark, root, "v4").collect()}
    assert told["added", "new"] is None and told["added_count", None] == 1 and told["processed_count", None] == 121 and told["retained_count", None] == 120
    # A field that is new today is null in the rows carried over.
    jobs.refresh(spark, rows(names).withColumn("phone", F.lit("1")), root, "v5", "2026-01-05", host, rules)
    assert {(r.slug == "new", r.phone) for r in publish.read_published(spark, root).collect()} == {(True, None), (False, "1")}


def test_refresh_finds_the_errors_of_a_record_once(spark, tmp_path, monkeypatch):
    asked, errors = [], quality.record_errors
    monkeypatch.setattr(quality, "record_errors", lambda host: asked.append(host) or errors(host))
    rows = spark.range(20).selectExpr(
        "cast(id as string) AS slug", "if(id = 3, '', 'n') AS name", "'c' AS city", "52.0 AS lat", "5.0 AS lon", "'active' AS status", "0 AS consecutive_missing",
        "cast(NULL as date) AS first_seen", "'https://h.example/x' AS official_url", "map('nl', 'https://h.example/x', 'en', 'https://h.example/x', 'uk', 'https://h.example/x') AS official_urls", "array('p') AS programmes")
    with pytest.raises(jobs.RefreshRejected, match="record_errors"):
        jobs.refresh(spark, rows, str(tmp_path / "a"), "v1", "2001-01-01", "h.example", quality.DatasetRules(min_rows=1, baseline_rows=20))
    jobs.refresh(spark, rows.where("name <> ''"), str(tmp_path / "b"), "v1", "2001-01-01", "h.example", quality.DatasetRules(min_rows=1, baseline_rows=19))
    assert len(asked) == 2 and "_errors" not in publish.read_published(spark, str(tmp_path / "b")).columns


def test_sanity_plan_does_not_grow_with_the_aliases(spark):
    rows = spark.createDataFrame([("x", "Alias7", "name", 52.0, 5.0), ("y", "Alias7", "other", 52.0, 5.0)], "slug string, province string, geo_province string, lat double, lon double")
    odd = geo_join.geo_sanity(rows, {f"alias{i}": "Name" for i in range(12)})
    assert odd._jdf.queryExecution().analyzed().toString().count("trim(") < 100
    assert [r.slug for r in odd.collect()] == ["y"]


def test_shared_resources_whitelist_needs_the_exact_group(spark):
    schema = "slug string, site string, street string, postcode string, city string, status string"
    data = [("domunder", None, "Plein 1", "1234 AB", "U", None), ("paleis-lofen", None, " plein 1", "1234ab", "u", None),
            ("km21", "https://a.nl/", "S 2", "1111 AA", "D", None), ("fotomuseum-den-haag", "http://A.nl", "s 2", "1111AA", "D", None), ("third", "https://a.nl", "S 2", "1111 AA", "d", None),
            ("gone", "https://a.nl", "S 2", "1111 AA", "d", "removed"), ("solo", "https://b.nl/x", "S 3", "1111 AA", "d", None)]
    allowed = spark.createDataFrame(quality.shared_groups(), "kind string, group_id int, slug string")
    got = rows_of(quality.shared_resources(spark.createDataFrame(data, schema), allowed), "kind", "n_keys", "slug")
    assert got == [(k, 3, s) for k in ("address", "site") for s in ("fotomuseum-den-haag", "km21", "third")]


def test_overrides(spark):
    schema = "slug string, name string, city string, address struct<street:string,postcode:string,city:string>"
    df = spark.createDataFrame([("a", "A", "Old", ("s", "p", "Old")), ("b", "B", "C", ("s", "p", "C")), ("c", "C", "C", ("s", "p", "C"))], schema)
    curated = spark.createDataFrame([("a", None, ("p2", "New")), ("b", "B", None)], "slug string, name string, address struct<postcode:string,city:string>")
    got = {r.slug: r for r in overrides.apply_overrides(df, curated).collect()}
    assert (got["a"].city, tuple(got["a"].address), got["a"].source_matches) == ("New", ("s", "p2", "New"), False)
    assert got["b"].source_matches and got["b"].city == "C" and not got["c"].source_matches


# --- ranks and picks under skew --------------------------------------------------------

def skewed(spark, n=6000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), (F.hash("id") % 100).alias("v"), "id")


def brute_ranks(df):
    seen, out = Counter(), {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.v, r.id)):
        seen[r.k] += 1
        out[r.id] = seen[r.k]
    return out


def test_rank_rows_within_hot_key(spark):
    df = skewed(spark)
    got = {r.id: r["rank"] for r in rank_rows(df, [F.col("v"), F.col("id")], ["k"]).collect()}
    assert got == brute_ranks(df)


def test_ranks_of_sparse_positions(spark):
    """Positions far apart rank as those side by side."""
    far = skewed(spark).withColumn("v", F.col("v") * 1_000_003)
    got = {r.id: r["rank"] for r in rank_rows(far, [F.col("v"), F.col("id")], ["k"]).collect()}
    assert got == brute_ranks(far)
    batches = [r.batch for r in lists.assign_batches(spark.range(95).selectExpr("id * 1000003 as k"), "k", 20).orderBy("k").collect()]
    assert batches == [i // 20 + 1 for i in range(95)]


def test_top_per_key_is_limited_before_the_shuffle(spark):
    plan = top_per_key(skewed(spark), ["k"], [F.col("v"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_quota_counts_only_successes(spark):
    data = [(i, i < 5 or i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(data, "request_id int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("request_id") * 60))
    got = {r.request_id: r.admitted for r in lists.quota_admit(df, F.to_date("ts"), 6).collect()}
    wanted = [i for i, ok in data if ok][:6][-1]
    assert got == {i: i <= wanted for i, _ in data}


@pytest.mark.parametrize("bound", [50, 1_000_000])
def test_quota_of_many_in_one_period(spark, bound):
    """A limit of 100,000 in one period, with many requests at one moment, over probes and without."""
    df = spark.range(250_000).select(F.col("id").alias("request_id"), (F.col("id") % 5 != 0).alias("ok"),
                                     F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 1_700_000_000).otherwise(1_700_000_000 + F.col("id") * 7919 % 86_400)).alias("ts"))
    for limit in (1, 30_000, 100_000, 10**6):
        got = lists.quota_admit(df, F.to_date("ts"), limit, bound=bound).where("period = '2023-11-14'")
        ranked = df.where("ok").where(F.to_date("ts") == "2023-11-14").orderBy("ts", "request_id").limit(limit)
        cut = ranked.agg(F.max(F.struct("ts", "request_id")).alias("c"), F.count("*").alias("n")).first()
        wrong = got.where((F.struct("ts", "request_id") <= F.struct(F.lit(cut.c.ts), F.lit(cut.c.request_id).cast("long"))) != F.col("admitted"))
        assert cut.n < limit or wrong.isEmpty()
        assert got.where("ok and admitted").count() == min(limit, cut.n)


# --- geo ---------------------------------------------------------------------------------

def km(a, b, c, d):
    p, q = math.radians(c - a), math.radians(d - b)
    h = math.sin(p / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(q / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("spread", [0.5, 30.0, 85.0])
def test_nearest_and_radius_against_brute_force(spark, spread):
    rnd = random.Random(7)
    place = lambda: (rnd.uniform(-spread, spread), rnd.uniform(-179.9, 179.9) if spread > 80 else rnd.uniform(-spread, spread))
    points = [(f"p{i}", *place()) for i in range(60)] + [("far", 89.0, 179.5), ("none", None, None)]
    places = [(i, f"t{i}", *place()) for i in range(40)] + [(40, "edge", 88.0, -179.5), (41, "dup", 0.1, 0.1), (42, "dup2", 0.1, 0.1)]
    p = spark.createDataFrame(points, "slug string, lat double, lon double")
    t = spark.createDataFrame(places, "pos int, place string, lat double, lon double")
    for bound in (1, 32):
        got = {r.slug: r.place for r in geo_join.nearest_place(p, t, bound=bound).collect()}
        for slug, lat, lon in points:
            want = None if lat is None else min(places, key=lambda x: (round(km(lat, lon, x[2], x[3]), 9), x[0]))[1]
            assert got[slug] == want
    for radius in (50.0, 900.0):
        near = {(r.slug, r.place) for r in geo_join.radius_join(p, t.drop("pos"), radius).collect()}
        assert near == {(s, x[1]) for s, a, b in points if a is not None for x in places if km(a, b, x[2], x[3]) <= radius}


def test_radius_join_deals_a_crowded_cell_over_many_tasks(spark, monkeypatch):
    """All points and places in one cell, some repeated: each pair is met once, and no task makes a third of them."""
    monkeypatch.setattr(geo_join, "RADIUS_PAIRS", 400, raising=False)
    monkeypatch.setattr(geo_join, "RADIUS_SIDE", 10, raising=False)
    rnd = random.Random(5)
    place = lambda: (rnd.uniform(51.01, 51.09), rnd.uniform(4.01, 4.09))
    points = [(f"p{i}", *place()) for i in range(90)] + [("p0", 51.05, 4.05), ("p0", 51.05, 4.05), (None, 51.05, 4.05), ("far", -30.0, 4.0), ("none", None, None)]
    places = [(f"t{i}", *place()) for i in range(70)] + [("t0", 51.02, 4.02), ("t0", 51.02, 4.02)]
    near = geo_join.radius_join(spark.createDataFrame(points, "slug string, lat double, lon double"), spark.createDataFrame(places, "place string, lat double, lon double"), 25.0)
    got = near.withColumn("task", F.spark_partition_id()).collect()
    want = [(s, x[0]) for s, a, b in points if a is not None for x in places if km(a, b, x[1], x[2]) <= 25.0]
    assert Counter((r.slug, r.place) for r in got) == Counter(want) and len(want) > 6_000
    assert max(Counter(r.task for r in got).values()) < len(want) / 3


def test_nearest_compares_few_pairs_in_a_dense_spot(spark):
    """All places but one far one within some hundred metres: pairs grow with the points, not with their square."""
    def around(n, seed):
        rnd = random.Random(seed)
        return [(52 + rnd.random() / 500, 5 + rnd.random() / 500) for _ in range(n)]

    per_point = []
    for n in (1000, 8000):
        spots = spark.createDataFrame([(a, b, i, f"t{i}") for i, (a, b) in enumerate([*around(n, 1), (-40.0, 170.0)])], "p_lat double, p_lon double, pos int, place string")
        tree, leaves, depth = geo_join.quad_tree(spots)
        assert leaves.count() == n + 1 and leaves.groupBy("code").count().agg(F.max("count")).first()[0] <= geo_join.CELL_PLACES
        sites = spark.createDataFrame(around(n, 2), "lat double, lon double")
        pairs = geo_join.near_leaves(sites, tree, depth).join(leaves, "code").count()
        per_point.append(pairs / n)
    assert max(per_point) < 3 * geo_join.CELL_PLACES


def test_nearest_without_places(spark):
    p = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], "slug string, lat double, lon double")
    none = spark.createDataFrame([], "pos int, place string, lat double, lon double")
    assert [(r.place, r.dist_km) for r in geo_join.nearest_place(p, none).collect()] == [(None, None)] * 2


def test_ladder_prefers_precise_wording_in_bounds(spark):
    df = spark.createDataFrame([("a", "N", "Plein 7b", "1234 AB", "Delft"), ("b", "M", None, None, "Delft"), ("c", "Q", None, None, None)], "slug string, name string, street string, postcode string, city string")
    gaz = spark.createDataFrame([("1234 AB 7b", 1, "adres", 10.0, 5.0), ("Plein 7b, Delft", 1, "weg", 52.0, 5.0), ("Plein 7b, Delft", 2, "adres", 52.5, 5.0), ("M, Delft", 1, "x", 51.0, 5.0)],
                                "query string, pos int, type string, lat double, lon double").withColumns({c: F.lit(None).cast("string") for c in ("woonplaats", "municipality", "province")})
    got = {r.slug: (r.tier, r.lat) for r in geo_join.match_ladder(df, gaz).collect()}
    assert got == {"a": (2, 52.5), "b": (4, 51.0), "c": (None, None)}


# --- finder ------------------------------------------------------------------------------

def test_search_finds_one_row_whatever_the_spelling(spark):
    df = cat.with_search_columns(spark.createDataFrame([("h", "Huis Zypendaal", "Arnhem", "Gelderland"), ("m", "Mauritshuis", "Den Haag", "Zuid-Holland")], "slug string, name string, city string, province string"))
    for q in ("zypendaal", "Zypendaal", "zypenda\u00e1l", "ZYPENDAAL"):
        assert rows_of(cat.search(df, q), "slug") == [("h",)]
    assert rows_of(cat.search(df, "the hague", {"The Hague": "Den Haag"}), "slug") == [("m",)]
    assert cat.search(df, "").count() == 2 and cat.search(df, "nothing").count() == 0


def test_unknown_ratings_and_prices_sort_last_both_ways(spark):
    df = spark.createDataFrame([("a", "a", None, 9, None), ("b", "b", 4.0, 1, 5.0), ("c", "c", 4.0, 3, 7.0)], "slug string, name string, rating double, reviews int, price double")
    order = lambda *keys: [r.slug for r in cat.sort_catalog(df, *keys).collect()]
    assert order("rating-desc") == ["c", "b", "a"] and order("price-asc") == ["b", "c", "a"] and order("price-desc") == ["c", "b", "a"] and order("reviews-desc") == ["a", "c", "b"]


# --- gates and agreement -------------------------------------------------------------------

def failure(spark, gate, **fields):
    schema = {"price": "decimal(9,2)", "previous": "decimal(9,2)"}
    row = [Decimal(str(v)) if k in schema and v is not None else v for k, v in fields.items()]
    return spark.createDataFrame([row], ", ".join(f"{k} {schema.get(k, 'string')}" for k in fields)).select(gate).first()[0]


def test_single_gates(spark):
    c = F.col
    literal = gates.gate_literal(c("page"), c("price"), c("quote"), c("status"), compat=False)
    base = dict(page="Volwassenen: \u20ac 12,50 per persoon", price=12.5, quote="Volwassenen \u20ac 12,50", status="paid")
    assert failure(spark, literal, **base) is None
    assert gates.LENGTH_FAILURE in failure(spark, literal, **{**base, "quote": "w " * 16})
    assert "not found verbatim" in failure(spark, literal, **{**base, "quote": "Kinderen gratis"})
    assert "price" in failure(spark, literal, **{**base, "price": 2.5})
    free = dict(page="kinderen gratis tot 18", price=None, quote="kinderen gratis", status="free")
    assert "youth" in failure(spark, literal, **free)
    span = gates.gate_range(c("price"), c("status"))
    assert failure(spark, span, price=45.0, status="paid") is None and failure(spark, span, price=45.01, status="paid")
    assert failure(spark, span, price=None, status="paid") and failure(spark, span, price=0.0, status="free") and failure(spark, span, price=None, status="closed") is None
    change = gates.gate_change(c("price"), c("previous"))
    assert failure(spark, change, price=13.0, previous=10.0) is None and failure(spark, change, price=13.01, previous=10.0) and failure(spark, change, price=5.0, previous=None) is None
    combo = gates.gate_combo(c("quote"))
    assert failure(spark, combo, quote="Combi ticket") and failure(spark, combo, quote="combinatie") is None
    domain = gates.gate_domain(c("s"), c("w"))
    assert failure(spark, domain, s="https://tickets.a.nl/x", w="https://www.a.nl") is None and failure(spark, domain, s="https://b.nl", w="https://a.nl") and failure(spark, domain, s="x", w=None) is None


def test_whole_words_beside_accents(spark):
    """Strict as in the SQL of gate_keyword and run_all_gates: an accented letter ends a word."""
    for quote, loose, strict in (("\u00e9combi", None, "combi"), ("duo\u00ef", None, "duo"), ("_combi combi2", None, None), ("x COMBO.", "combo", "combo")):
        assert failure(spark, gates.keyword_hit(F.col("quote")), quote=quote) == loose
        assert failure(spark, gates.keyword_hit(F.col("quote"), compat=False), quote=quote) == strict
        assert (failure(spark, gates.gate_combo(F.col("quote"), compat=False), quote=quote) is None) == (strict is None)


def test_confidence(spark):
    conf = lambda **f: failure(spark, gates.calibrate_confidence(F.col("status"), F.col("quote"), F.lit(f.pop("n", 0)), F.col("raw")), **f)
    assert conf(status="paid", quote="Volwassenen 10", raw=None) == "high" and conf(status="paid", quote="Vanaf 13 jaar 10", raw="high") == "medium"
    assert conf(status="paid", quote="prijs 10", raw="high") == "medium" and conf(status="paid", quote="", raw="high") == "low" and conf(status="closed", quote=None, raw=None) == "medium"
    assert conf(status="blocked_by_robots", quote=None, raw=None) == "blocked_by_robots" and conf(status="paid", quote="adult 10", raw=None, n=2) == "medium"


QUOTES = [
    # as it stands, whatever the case, white space and marks between
    ("Entree: 12,50", "De entree  12,50 per persoon", True), ("kassa|dicht", "KASSA - DICHT", True), ("a&nbsp;b", "x A B y", True), ("<b> c", "b c", True),
    # parts around dots, in order and not overlapping
    ("open ... dicht", "nu open en straks dicht", True), ("dicht ... open", "nu open en straks dicht", False), ("aba\u2026aba", "xababax", False), ("aba...aba", "aba aba", True),
    # words in order inside a window that starts with the first one
    ("een twee", "een drie twee", True), ("twee een", "een drie twee", False), ("een twee", "een " + "x " * 118 + "twee", True),
    ("een twee", "een " + "x " * 130 + "twee", False), ("een twee", "een " + "x " * 130 + "een en twee", True), ("een", "geen", True), ("niets", "een drie twee", False),
]


def test_quote_lookup(spark):
    rows = [(i, q, t) for i, (q, t, _) in enumerate(QUOTES)]
    got = {r.i: r.quote_found for r in gates.quote_in_text(spark.createDataFrame(rows, "i int, q string, t string"), "q", "t").collect()}
    assert [got[i] for i in range(len(QUOTES))] == [want for _, _, want in QUOTES]


def test_quotes_taken_from_a_text_are_found(spark):
    """Any run of words is found, also with words left out between; a foreign last word never is."""
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        text = [f"w{rnd.randint(0, 30)}x" for _ in range(rnd.randint(5, 60))]
        a, n = rnd.randint(0, len(text) - 4), rnd.randint(2, 4)
        run = text[a:a + n]
        rows += [(3 * i, " ".join(run), " ".join(text)), (3 * i + 1, " ... ".join(run), " ".join(text)), (3 * i + 2, " ".join([*run, "zzz"]), " ".join(text))]
    got = {r.i: r.quote_found for r in gates.quote_in_text(spark.createDataFrame(rows, "i int, q string, t string"), "q", "t").collect()}
    assert all(got[i] == (i % 3 < 2) for i, _, _ in rows)


def test_mojibake_quote(spark):
    df = spark.createDataFrame([("\u00e2\u201a\u00ac 12,00", "Entree \u20ac\u00a012,00")], "q string, t string")
    assert gates.quote_in_text(df, "q", "t").first().quote_found


ANSWER = ("struct<status:string,price:decimal(9,2),door:decimal(9,2),online:decimal(9,2),cheapest:decimal(9,2),variants:map<string,decimal(9,2)>,"
          "quote:string,source_url:string,page_title:string,free_for:array<string>,note:string,reason:string>")


def answer(status="paid", price="12.50", door=None, quote="Volwassenen 12,50", url="https://www.a.nl/t", variants=None, free_for=("ICOM",)):
    d = lambda x: None if x is None else Decimal(x)
    return (status, d(price), d(door), None, None, variants, quote, url, "", list(free_for), "", "plain")


def agreed(spark, m1, m2, page="Volwassenen 12,50 kassa 14,00 gratis 13,50"):
    df = spark.createDataFrame([("a", "A", "https://www.a.nl/", page, m1, m2)], f"slug string, name string, website string, page_text string, m1 {ANSWER}, m2 {ANSWER}")
    return agreement.merge_agreed(agreement.agreement_confidence(agreement.agree(agreement.check_both(df)))).first()


def test_agreement(spark):
    same = agreed(spark, answer(), answer(variants={"weekend": Decimal("14.00")}, free_for=("Youth",)))
    assert same.is_agreed and same.confidence == "high" and same.record.free_for == ["icom", "youth"] and same.record.variants == {"weekend": Decimal("14.00")}
    one = agreed(spark, answer(), answer(status="unknown", price=None))
    assert one.is_agreed and one.confidence == "medium" and one.record.mode == "dual_model_fallback_m1"
    other = agreed(spark, answer(url="https://b.nl"), answer(price="13.50"))
    assert other.record.mode == "dual_model_fallback_m2" and other.record.price == Decimal("13.50")
    assert agreed(spark, answer(), answer(price="13.50")).disagreement_type == "price_mismatch"
    door = agreed(spark, answer(door="14.00"), answer(price="14.00"))
    assert door.is_agreed and door.record.price == Decimal("12.50") and door.record.online == Decimal("12.50")
    assert agreed(spark, answer(), answer(status="free", price=None, quote="gratis")).disagreement_type == "status_mismatch"
    assert agreed(spark, answer(quote="nowhere"), answer(price="60.00")).disagreement_type == "gate_failure_model1"
    assert agreed(spark, answer(status="retry_later", price=None), answer()).disagreement_type == "retry_later"


RESULT = "slug string, seq bigint, name string, status string, price decimal(9,2), confidence string, is_accepted boolean, disagreement_type string, failures array<string>"


def test_store_split(spark):
    d = Decimal("10.00")
    results = spark.createDataFrame([
        ("ok", 1, "Ok", "paid", d, "high", True, None, []), ("bad", 1, "Bad", "needs_review", None, "low", False, "price_mismatch", ["f"]),
        ("wait", 1, "W", "retry_later", None, "low", False, "retry_later", []), ("hand", 1, "H", "paid", d, "high", True, None, [])], RESULT)
    prices = spark.createDataFrame([("bad", "Bad", d, None), ("hand", "H", Decimal("1.00"), "manual")], "slug string, name string, price decimal(9,2), entered_by string")
    review = spark.createDataFrame([("ok", "Ok", "old", [])], "slug string, name string, disagreement_type string, failures array<string>")
    p, r = stores.save_agreed(results, prices, review)
    assert rows_of(p, "slug", "price") == [("hand", Decimal("1.00")), ("ok", d)] and rows_of(r, "slug", "disagreement_type") == [("bad", "price_mismatch")]


def test_record_results_against_a_loop(spark):
    rnd = random.Random(5)
    prices = {f"k{i}": ("manual" if i % 4 == 0 else None, "p") for i in range(0, 30, 2)}
    review, results = {f"k{i}": "r" for i in range(0, 30, 3)}, []
    for seq in range(300):
        results.append((f"k{rnd.randint(0, 29)}", seq, f"n{seq}", Decimal(seq), rnd.choice([None, None, "manual"]), rnd.random() < 0.5, ["f"]))
    want_p, want_r = {k: v for k, v in prices.items()}, dict(review)
    for slug, _, name, _, by, ok, _ in results:
        held = slug in want_p and want_p[slug][0] == "manual"
        if held and by != "manual":
            continue
        if ok:
            want_p[slug] = (by, name)
            want_r.pop(slug, None)
        else:
            want_r[slug] = name
            if slug in want_p and not held:
                del want_p[slug]
    p, r = stores.record_results(
        spark.createDataFrame(results, "slug string, seq bigint, name string, price decimal(9,2), entered_by string, is_accepted boolean, failures array<string>"),
        spark.createDataFrame([(k, n, Decimal(1), b) for k, (b, n) in prices.items()], "slug string, name string, price decimal(9,2), entered_by string"),
        spark.createDataFrame([(k, n, Decimal(1), []) for k, n in review.items()], "slug string, name string, price decimal(9,2), failures array<string>"))
    assert {x.slug: (x.entered_by, x.name) for x in p.collect()} == want_p and {x.slug: x.name for x in r.collect()} == want_r


# --- documents, lists, mining ----------------------------------------------------------------

def test_feed_takes_the_last_area_with_a_listing(spark):
    area = lambda *cs: {"content": [{"component": c, "articles": [f"{c}-{n}"]} for c, n in cs]}
    body = [{"contentAreas": [area(("all-articles", 1)), area(("x", 2))]}, {"contentAreas": [area(("x", 3), ("article-overview", 4), ("all-articles", 5)), area(("x", 6))]}]
    df = spark.createDataFrame([(json.dumps(body),), ("[]",)], "j string").select(F.from_json("j", "array<struct<contentAreas:array<struct<content:array<struct<component:string,articles:array<string>>>>>>>").alias("body"))
    assert rows_of(documents.read_feed(df), "article") == [("article-overview-4",)]


def test_missing_files_are_empty(spark, tmp_path):
    schema = spark.createDataFrame([], "slug string").schema
    assert documents.read_wrapped(spark, str(tmp_path / "no"), "museums", schema).count() == 0
    assert documents.load_lookup(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "a.yaml").write_text('# c\n"\'s-Gravenhage": "Den Haag"\n\'t Gooi: Gooi\nplain: Some Town\n')
    assert rows_of(documents.load_lookup(spark, str(tmp_path / "a.yaml"))) == [("'s-Gravenhage", "Den Haag"), ("plain", "Some Town")]
    (tmp_path / "w.json").write_text(json.dumps({"source": 1, "museums": [{"slug": "a"}, {"slug": "b"}]}, indent=1))
    assert rows_of(documents.read_wrapped(spark, str(tmp_path / "w.json"), "museums", schema)) == [("a",), ("b",)]


def test_contact_block(spark):
    para = lambda *lines: {"type": "paragraph", "content": [x for l in lines for x in ({"type": "text", "text": l}, {"type": "hard_break"})]}
    link = {"type": "paragraph", "content": [{"type": "text", "text": "site", "marks": [{"type": "link", "attrs": {"href": "https://museum.example"}}]}]}
    docs = [[link, para("Contact", "Utrechtseweg 87", "6812 AA Arnhem (Gelderland)")], [{"type": "doc", "content": [para("Plein 12 297 BP", "Den Haag")]}], [para("none")]]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(contact.paragraphs("j").alias("p"))
    got = [tuple(r) for r in contact.contact_block(df, "p", compat=False).select("street", "postcode", "city", "site").collect()]
    assert got == [("Utrechtseweg 87", "6812 AA", "Arnhem", "https://museum.example"), ("Plein 12", "297 BP", "Den Haag", None), (None, None, None, None)]


def test_contact_at_any_depth(spark):
    para = {"type": "paragraph", "content": [{"type": "text", "text": "Dam 1"}, {"type": "hard_break"}, {"type": "text", "text": "1012 JS Amsterdam"}]}
    docs = []
    for depth in (0, 4, 9, 200):
        node = [para]
        for i in range(depth):
            node = {"type": "section", ("content", "blocks", "x")[i % 3]: node}
        docs.append(json.dumps(node))
    df = spark.createDataFrame([(d,) for d in [*docs, "not json", "", None]], "j string").select(contact.paragraphs("j").alias("p"))
    got = [r.postcode for r in contact.contact_block(df, "p", compat=False).select("postcode").collect()]
    assert got == ["1012 JS"] * 4 + [None] * 3


def test_long_list_round_trip(spark):
    items = spark.range(2000).selectExpr("'o' as owner", "concat('i', id) as item", "id * 7919 as pos", "id % 2 = 0 as visited", "'' as note")
    names = spark.createDataFrame([], "slug string, name string")
    ranked = lists.rank_items(items)
    for chunk, parts in ((None, 1), (300, 7)):
        docs = lists.export_documents(ranked, names, "2026-01-01T00:00:00Z", chunk=chunk)
        assert docs.count() == parts
        back = sorted(lists.parse_documents(docs, "document").collect(), key=lambda r: (r.part, r.pos))
        assert [r.slug for r in back] == [f"i{i}" for i in range(2000)]


def test_unknown_overrides_are_errors(spark):
    df = spark.createDataFrame([("a", "x")], "slug string, name string")
    with pytest.raises(ValueError, match="nope"):
        overrides.apply_overrides(df, spark.createDataFrame([("a", "y")], "slug string, nope string"))


def test_list_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("o", "b", 2, True, 'say "hi"'), ("o", "a", 1, False, None), ("o", "b", 3, False, "later")], "owner string, item string, pos int, visited boolean, note string")
    ranked = lists.rank_items(lists.dedupe_keep_first(items))
    names = spark.createDataFrame([("a", "Alpha", "X", "P", "https://a.nl")], "slug string, name string, city string, province string, website string")
    docs = lists.export_documents(ranked, names, "2026-01-01T00:00:00Z")
    assert [i["name"] for i in json.loads(docs.first().document)["items"]] == ["Alpha", "b"]
    assert rows_of(lists.parse_documents(docs, "document"), "slug", "visited", "note") == [("a", False, ""), ("b", True, 'say "hi"')]
    publish.write_csv(lists.export_rows(ranked, names).drop("owner").orderBy("Rank").coalesce(1), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part*.csv")).read_bytes().decode()
    assert raw.startswith('\ufeff"Rank"') or raw.startswith('"\ufeffRank"')
    assert '"1","a","Alpha"' in raw and '"say ""hi"""' in raw and "\r\n" in raw


def test_wrapped_documents_keep_places_over_many_files(spark, tmp_path):
    import json
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("slug string, price decimal(9,2), tags array<string>")
    rows = lambda i: [{"slug": f"s{i}-{k}", "price": k / 4, "tags": ["t"] * k} for k in range(i % 4)]
    (tmp_path / "store").mkdir()
    for i in range(1000):
        (tmp_path / "store" / f"{i:04}.json").write_text(json.dumps({"meta": {"n": i}, "rows": rows(i)}, indent=1))
    df = documents.read_wrapped(spark, str(tmp_path / "store"), "rows", schema, positions=True)
    assert df.rdd.getNumPartitions() > 1
    got = sorted((r.file[-9:-5], r.pos, r.slug, float(r.price), r.tags) for r in df.collect())
    assert got == [(f"{i:04}", k, r["slug"], r["price"], r["tags"]) for i in range(1000) for k, r in enumerate(rows(i))]
    odd = [(1, '[{"slug": "a", "price": "x"}, null, {"price": 2}]'), (2, '{"rows": [{"slug": 3}]}'), (3, '{"other": [1]}'), (4, "{"), (5, None), (6, "[]"), (7, '{"rows": {"a": 1}}')]
    listed = documents.read_wrapped_or_list(spark.createDataFrame(odd, "id int, doc string"), "doc", "rows", schema)
    assert rows_of(listed.select("id", "slug", F.col("price").cast("string"))) == sorted([(1, "a", None), (1, None, None), (1, None, "2.00"), (2, "3", None)], key=repr)


def test_answers(spark):
    rows = ['{"status": "paid", "primary_adult_eur": 12.5}', 'x\n```json\n{"status": "free"}\n```', 'so {"status": "closed", "a": {"b": 1}} ok', '{"status": "paid", "adult_eur": "7", "note": "cut o', "none", "[1]"]
    got = mining.answer_fields(mining.parse_answers(spark.createDataFrame([(r,) for r in rows], "raw string"), "raw"))
    assert [(r.status, r.primary_adult_eur) for r in got.collect()] == [("paid", 12.5), ("free", None), ("closed", None), ("paid", 7.0), ("unknown", None), ("unknown", None)]


def test_contexts_match_plain_search(spark):
    import re
    body = "Adres 1234 AB stad " * 9 + "slot 9999zz"
    many = "é1234 AB " + "ß\u00a0 1234ab,\n5678 CD\U0001f600 x9999ZZ " * 300 + "1111 QQ"
    bodies = {1: body, 2: "none", 3: many, 4: None, 5: "", 6: "4321 XY"}
    df = mining.pattern_contexts(spark.createDataFrame(list(bodies.items()), "i int, t string"), "t", width=30, quote_words=3)
    want = []
    for i, text in bodies.items():
        for m in re.finditer(vocab.POSTCODE_ANYCASE_PATTERN, text or ""):
            words = text[max(0, m.start() - 30):m.end() + 30].split()
            want.append((i, m.start(), m.group(), " ".join(words), " ".join(words[:3])))
    assert rows_of(df, "i", "start", "match", "window", "quote") == sorted(want, key=repr)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_reachability_from_either_end(spark):
    edges = [("a", "b"), ("b", "c/"), ("c/", "d")] + [("hub", f"x{i}") for i in range(50)] + [(f"y{i}", "sink") for i in range(50)] + [("x1", "sink"), ("hub", "y3")]
    pairs = [("c", "a", True), ("d", "a", False), ("sink", "hub", True), ("A/", "a", True), ("b", "a", True), ("zz", "a", False)]
    df = links.link_reachable(spark.createDataFrame([(t, o) for t, o, _ in pairs], "target string, origin string"), spark.createDataFrame(edges, "src string, dst string"))
    assert rows_of(df, "target", "origin", "reachable") == sorted(pairs, key=repr)


def test_same_address_strict(spark):
    """Strict, an address that differs in case or closing slash takes a link."""
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    pairs, edges = df([("A/", "a"), ("a", "a"), ("B", "b"), ("b/", "c")], ("target", "origin")), df([("b", "x"), ("x", "b/"), ("c", "c")], ("src", "dst"))
    got = lambda compat: dict(((r.target, r.origin), r.reachable) for r in links.link_reachable(pairs, edges, compat=compat).collect())
    assert got(False) == {("A/", "a"): False, ("a", "a"): True, ("B", "b"): True, ("b/", "c"): False}
    assert got(True)[("A/", "a")] and not got(True)[("b/", "c")]


def test_link_distance_against_a_walk(spark):
    """Depths 0 to 4 on a random graph with a hub, against a breadth-first walk."""
    rnd = random.Random(11)
    edges = {(f"n{rnd.randint(0, 40)}", f"n{rnd.randint(0, 40)}" + "/" * rnd.randint(0, 1)) for _ in range(70)} | {("n0", f"N{i}") for i in range(40)}
    pairs = [(f"n{rnd.randint(0, 45)}", f"n{rnd.randint(0, 45)}") for _ in range(150)] + [(None, "n1"), ("n1", None)]
    e, p = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(pairs, "target string, origin string")

    def steps(target, origin, depth):
        if target is None or origin is None:
            return None
        end = lambda x: x.rstrip("/").lower()
        if end(target) == end(origin):
            return 0
        level = seen = {origin}
        for step in range(1, depth + 1):
            level = {b for a, b in edges if a in level} - seen
            if end(target) in {end(b) for a, b in edges if a in seen}:
                return step
            seen = seen | level
        return None

    for depth in range(5):
        got = rows_of(links.link_distance(p, e, depth), "target", "origin", "steps")
        assert got == sorted([(t, o, steps(t, o, depth)) for t, o in pairs], key=repr)


def test_proposals_and_reports(spark):
    review = spark.createDataFrame([(["Quote not found verbatim", "Range gate: x"], None, None), ([], "reject", None), (None, None, "blocked_by_bot_protection"), (["odd"], None, None)], "failures array<string>, verdict string, status string")
    assert dict(rows_of(audit.failure_histogram(review))) == {"literal_quote_mismatch": 1, "range_out_of_bounds": 1, "verifier_rejected": 1, "bot_protection": 1, "unspecified_review": 1}
    ident = "struct<title:string,h1:string,meta_description:string,body_preview:string>"
    rows = [("s", "Zilvermuseum", "Schoonhoven", 1, "https://www.zilver.nl/en/x", ("Nederlands Zilvermuseum", "", "museum", "")), ("s", "Zilvermuseum", "Schoonhoven", 2, "https://b.nl/", ("Zilvermuseum Schoonhoven", "", "", "")), ("t", "Niets", None, 1, "https://c.nl", ("domain for sale niets", "", "", ""))]
    got = propose.website_proposals(spark.createDataFrame(rows, f"slug string, name string, city string, rank int, url string, identity {ident}"), "2026-01-01").collect()
    assert [(r.slug, r.proposed_value, r.confidence) for r in got] == [("s", "https://www.zilver.nl/", "high")]


def test_recheck_verdicts(spark):
    rows = [("", None, 200, "x", "prijs"), ("ftp://a.nl", None, 200, "x", "prijs"), ("https://a.nl/p", None, 404, "https://a.nl/p", ""), ("https://a.nl/p", "https://www.a.nl", 200, "https://b.nl/p", "prijs"),
            ("https://a.nl/p", "https://a.nl", 200, "https://a.nl/", "prijs"), ("https://a.nl/p", "https://a.nl", 200, "https://www.a.nl/p", "niets"), ("https://a.nl/p", "https://a.nl", 200, "https://shop.a.nl/p", "Entree \u20ac 5")]
    got = [r.failure for r in recheck.source_verdict(spark.createDataFrame(rows, "source_url string, website string, http_status int, final_url string, body string")).collect()]
    assert got == ["missing source_url", "invalid scheme", "HTTP 404", "redirected to external domain", "redirected to homepage root", "no pricing keywords", None]
