"""The jobs a user runs: refresh, enrich, propose, audit, report, recheck, evaluate, find."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import html, vocab
from ..functions.geo import normalise_postcode
from ..functions.text import contains_any, localized_urls, normalise_text
from ..operators import agreement, audit, catalog as cat, gates, geo_join, links, mining, propose as prop, quality, recheck as rc, snapshot, standardise, stores
from ..operators.overrides import apply_overrides
from ..operators.scale import top_per_key
from ..session import materialise
from ..sources import publish


class RefreshRejected(ValueError):
    """The merged snapshot failed its gates; nothing was published."""


@dataclass
class RefreshInputs:
    """Tables of one refresh: parsed feed rows and the curated side tables."""
    feed: DataFrame
    lookup_province: DataFrame
    lookup_city: DataFrame
    overrides: DataFrame
    gazetteer: DataFrame
    cache: DataFrame | None = None


#: Catalogue fields that no feed has and an override may set.
CURATED = {"lat": "double", "lon": "double", "woonplaats": "string", "municipality": "string", "status": "string",
           "consecutive_missing": "int", "duplicate_of": "string"}


def enriched_catalog(inputs: RefreshInputs, base_url: str, as_of: str) -> DataFrame:
    """Feed rows normalised, overridden and located; no action is run."""
    live = snapshot.reconcile_published(inputs.feed).where("reason is null").drop("reason")
    named = live.withColumns({
        "name": F.coalesce(normalise_text(F.col("name")), F.col("name")),
        "street": F.coalesce(normalise_text(F.col("street")), F.lit("")),
        "postcode": F.coalesce(normalise_postcode(F.col("postcode")), F.lit("")),
        "city": normalise_text(F.col("city"))})
    rows = standardise.resolve_term(named, "province", inputs.lookup_province)
    urls = localized_urls(base_url, F.col("slug"))
    rows = rows.select(
        "slug", "name", "province", "city", F.struct("street", "postcode", F.coalesce("city", F.lit("")).alias("city")).alias("address"),
        urls[vocab.CANONICAL_LOCALE].alias("official_url"), urls.alias("official_urls"), "museum_website", "source_date_raw",
        F.lit(as_of).cast("date").alias("first_seen"), F.array(F.lit("default")).alias("programmes"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in CURATED.items()])
    rows = apply_overrides(rows, inputs.overrides)
    place = rows.select("slug", "name", "city", F.col("address.street").alias("street"), F.col("address.postcode").alias("postcode"))
    hits = geo_join.match_ladder(place, inputs.gazetteer)
    if inputs.cache is not None:
        cached = geo_join.cache_join(place, inputs.cache).where("cache_hit").select(
            "slug", F.struct("lat", "lon", F.col("place").alias("woonplaats"), F.col("place").alias("municipality"), F.lit(None).cast("string").alias("province")).alias("_c"))
        hits = hits.join(cached, "slug", "left").select("slug", *[
            F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon", "woonplaats", "municipality", "province")])
    # What was curated by hand stands above what the gazetteer found.
    places = ("lat", "lon", "woonplaats", "municipality")
    rows = geo_join.geo_enrich(rows.withColumn("_curated", F.struct(*places)), hits)
    rows = rows.withColumns({name: F.coalesce(F.col(f"_curated.{name}"), F.col(name)) for name in places}).drop("_curated")
    rows = standardise.resolve_term(rows, "city", inputs.lookup_city)
    return rows.withColumns({"address": F.col("address").withField("city", F.coalesce("city", F.lit(""))),
                             "status": F.coalesce("status", F.lit("active")), "consecutive_missing": F.coalesce("consecutive_missing", F.lit(0))})


def refresh(spark: SparkSession, current: DataFrame, root: str, version: str, as_of: str, host: str,
            rules: quality.DatasetRules = quality.DatasetRules(), build_id: str = "", limit: int | None = None,
            excluded: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Merge, gate, publish and report; returns the verdict row. Raises before publishing when a gate fails.

    ``limit`` keeps the first rows in key order, for trial runs. The published rows are in
    snapshot order: active ones first, then by key. A field new in ``current`` is null in the rows carried over.

    The located rows and the merged snapshot are each written once to the shared folder, counted while they
    are, and read by the gate, the difference, the publisher and the report. ``excluded`` (slug, reason) tells
    what the feed held back, ``allowed`` the shared sites and addresses that are fine; see `refresh_findings`.
    """
    current = current if limit is None else current.orderBy("slug").limit(limit)
    taken, kept = Observation("current"), Observation("merged")
    current = materialise(current.observe(taken, F.count(F.lit(1)).alias("active_count")), "current")
    if taken.get["active_count"] == 0:
        raise ValueError("no articles found in the feed")
    previous = publish.read_published(spark, root)
    fields = [c for c in current.columns if c not in ("source_matches", "geo_province")]
    fresh = current.select(*fields)
    old = fresh.limit(0) if previous is None else previous.select(*[
        F.col(c) if c in previous.columns else F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in fields])
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    merged = snapshot.soft_delete_merge(fresh, old, as_of=as_of)
    # The errors of a record are found once, for the gate and the report; they are not published.
    checked = materialise(merged.withColumn("_errors", quality.record_errors(host)).observe(
        kept, F.count(F.lit(1)).alias("processed"), F.count_if(located).alias("complete")), "merged")
    merged = checked.drop("_errors")
    verdict = materialise(quality.dataset_verdict(checked, previous, rules, F.col("_errors")), "verdict")
    row = verdict.first()
    if not row.is_valid:
        raise RefreshRejected(", ".join(row.failed_rules))
    empty = merged.limit(0)
    diff = materialise(snapshot.snapshot_diff(merged, previous if previous is not None else empty, active_keys=True), "diff")
    entry = snapshot.changelog_entry(diff, merged, as_of, first_run=previous is None)
    keys = diff.withColumn("timestamp", F.lit(as_of).cast("timestamp"))
    # Records first, each under its version: a retry writes them again, and the manifest comes last.
    publish.append_changelog(entry, keys, root, version)
    publish.run_meta(merged, as_of, build_id).write.mode("overwrite").parquet(f"{root}/meta/version={version}")
    findings = materialise(quality.refresh_findings(current, checked, diff, excluded, F.col("_errors"), allowed), "findings")
    processed, complete = kept.get["processed"], kept.get["complete"]
    totals = {("reconciliation", "active_count"): taken.get["active_count"], ("validation", "is_valid"): 1,
              ("processed", "processed_count"): processed, ("geocoding_completeness", "complete_count"): complete,
              ("geocoding_completeness", "percentage"): round(complete / processed * 100.0, 1), ("diff", "retained_count"): diff.where("change = 'retained'").count()}
    publish.write_report(quality.refresh_report(findings, totals), root, version)
    publish.publish_if_changed(snapshot.snapshot_order(merged), root, version)
    return verdict


def page_context(pages: DataFrame, catalog: DataFrame, max_pages: int = 4) -> DataFrame:
    """(slug, page_text, n_pages) from pages(slug, rank, html); text of the chosen pages joined."""
    read = top_per_key(pages.select("slug", "rank", "html"), ["slug"], [F.col("rank")], max_pages, "_n")
    read = html.with_visible_text(read, "html", "_text")
    text = read.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("_n", "_text"))).alias("_p"))
    return catalog.select("slug", "name", "city", F.col("museum_website").alias("website")).join(
        text.select("slug", F.array_join(F.transform("_p", lambda p: p["_text"]), "\n").alias("page_text")), "slug", "left")


def enrich_prices(extractions: DataFrame, context: DataFrame, compat: bool = True) -> DataFrame:
    """Two answers per entity -> gates, agreement, confidence and the merged record."""
    pairs = agreement.pair_answers(extractions).join(context, "slug")
    checked = agreement.check_both(pairs.withColumn("page_text", F.coalesce("page_text", F.lit(""))), compat)
    return agreement.merge_agreed(agreement.agreement_confidence(agreement.agree(checked)))


#: Columns of both stores; a store that lacks some keeps those it has.
PRICE_STORE = ("slug", "name", "status", "price", "door", "online", "cheapest", "variants", "free_for", "quote", "source_url", "page_title",
               "note", "reason", "mode", "confidence", "checked_on", "entered_by")
REVIEW_STORE = ("slug", "name", "status", "verdict", "disagreement_type", "failures", "model1", "model2", "timestamp")


def results_of(enriched: DataFrame, checked_on: str | None = None) -> DataFrame:
    """Rows for ``stores.save_agreed``: the whole record, both answers and the time."""
    fields = [c for c in PRICE_STORE if c in enriched.schema["record"].dataType.names and c not in ("confidence",)]
    when = F.lit(checked_on).cast("string")
    return enriched.select(
        "slug", F.lit(0).cast("bigint").alias("seq"), "name", *[F.col(f"record.{c}").alias(c) for c in fields], "confidence", when.alias("checked_on"),
        F.col("is_agreed").alias("is_accepted"), F.when(~F.col("is_agreed"), "reject").alias("verdict"), "disagreement_type", F.concat("fails1", "fails2").alias("failures"),
        F.col("m1").alias("model1"), F.col("m2").alias("model2"), when.alias("timestamp"))


def empty_stores(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price and review stores without rows, for a first run over ``results``."""
    none = results.limit(0).withColumn("entered_by", F.lit(None).cast("string"))
    return none.select(*PRICE_STORE), none.select(*REVIEW_STORE)


def propose_websites(catalog: DataFrame, pages: DataFrame, hits: DataFrame, checked_on: str) -> DataFrame:
    """Entities without a site, their best candidate pages and a confirmed proposal."""
    lacking = cat.missing_targets(snapshot.active_only(catalog), "museum_website")
    tokens = gates.distinctive_tokens(F.col("name"), F.col("city"))
    found = hits.where(~links.is_blocklisted(F.col("url"))).join(lacking.select("slug", tokens.alias("tokens")), "slug")
    best = links.score_candidates(found)
    identified = html.with_identity(pages, "html", "identity").select("url", "identity")
    rows = best.join(identified, "url").join(lacking.select("slug", "name", "city"), "slug")
    return prop.website_proposals(rows, checked_on)


def propose_addresses(catalog: DataFrame, contact_pages: DataFrame, checked_on: str) -> DataFrame:
    """contact_pages(slug, page_rank, url, html) -> differing postcodes found on them."""
    text = html.with_visible_text(contact_pages, "html", "body").select("slug", "page_rank", "url", "body")
    contexts = mining.pattern_contexts(text, "body")
    rows = snapshot.active_only(catalog).select("slug", F.col("address.postcode").alias("postcode"))
    return prop.address_proposals(rows, contexts, checked_on)


def audit_identity(catalog: DataFrame, pages: DataFrame, compat: bool = True) -> DataFrame:
    """pages(url, html) of the entities' own sites -> identity status per active entity."""
    rows = snapshot.active_only(catalog).select("slug", "name", "city", F.col("museum_website").alias("url"))
    read = html.with_identity(pages, "html", "identity").select("url", "identity")
    joined = rows.join(read, "url", "left")
    checked = gates.identity_status(joined, "name", "city", "identity", compat)
    status = (F.when(F.coalesce(F.col("url"), F.lit("")) == "", "missing_website").when(F.col("identity").isNull(), "fetch_failed").otherwise(F.col("identity_status")))
    return checked.withColumn("identity_status", status)


def report(prices: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    return audit.status_report(prices), audit.failure_histogram(review)


def recheck(prices: DataFrame, review: DataFrame, fetch_log: DataFrame, enriched: DataFrame, apply: bool = False, checked_on: str | None = None):
    """(verdicts, deltas, stores): stored sources checked, results classed, stores updated on ``apply``.

    The stores keep their columns, so they can be rechecked and reported again.
    """
    verdicts = rc.source_verdict(fetch_log)
    now = enriched.select("slug", F.col("is_agreed").alias("is_accepted"), F.col("record.status").alias("status"), F.col("record.price").alias("price"))
    deltas = agreement.recheck_delta(prices.select("slug", "status", "price"), now)
    updated = stores.save_agreed(results_of(enriched, checked_on), prices, review) if apply else None
    return verdicts, deltas, updated


def evaluate(cases: DataFrame, compat: bool = True) -> DataFrame:
    """Labelled claims (gate columns plus cohort, category, subtype, verdict) -> metrics per cohort."""
    return audit.cohort_metrics(gates.run_all_gates(cases, compat).withColumnRenamed("passed", "gates_passed"))


@dataclass
class Finder:
    """One catalogue query: search, facets, distance, bands and two sort keys."""
    query: str = ""
    aliases: Mapping[str, str] = field(default_factory=dict)
    province: str | None = None
    city: str | None = None
    categories: tuple[str, ...] = ()
    band: str | None = None
    min_rating: float = 0.0
    min_reviews: int = 0
    at: tuple[float, float] | None = None
    max_km: float | None = None
    hide_visited: bool = False
    sort: str = "name"
    then: str = "none"

    def filter(self, view: DataFrame) -> DataFrame:
        rows = cat.search(view, self.query, self.aliases)
        rows = cat.facet_filter(rows, self.province, self.city, self.categories, self.hide_visited)
        rows = cat.min_score(cat.band_filter(rows, self.band), self.min_rating, self.min_reviews)
        return rows if self.at is None else cat.with_distance(rows, *self.at, self.max_km)

    def run(self, view: DataFrame) -> DataFrame:
        return cat.sort_catalog(self.filter(view), self.sort, self.then)
