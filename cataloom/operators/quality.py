"""Record errors, dataset gates, shared resources, completeness and the run report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.geo import in_bbox
from ..functions.text import empty_to_null
from ..functions.urls import netloc, normalise_site
from .geo_join import geo_sanity
from .scale import null_safe
from .snapshot import active


def given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def record_errors(host: str, locales: Sequence[str] = vocab.LOCALES) -> Column:
    """Array of error texts for one catalogue row (slug, name, official_url(s), lat, lon, programmes)."""
    slug = F.coalesce(F.col("slug"), F.lit(""))
    urls = F.col("official_urls")
    checks = [
        F.when(~given(F.col("slug")), F.lit("Empty slug")),
        F.when(~given(F.col("name")), F.concat(F.lit("Empty name: "), slug)),
        F.when(~given(F.col("official_url")), F.concat(F.lit("Missing official_url: "), slug))
        .when(netloc(F.col("official_url")) != host, F.concat(F.lit("Invalid official_url host: "), slug)),
    ]
    for locale in locales:
        checks.append(F.when(urls.isNull() | urls[locale].isNull(), F.concat(F.lit(f"Missing official_urls[{locale}]: "), slug))
                      .when(netloc(urls[locale]) != host, F.concat(F.lit(f"Invalid official_urls[{locale}] host: "), slug)))
    bad_items = F.col("programmes").isNull() | (F.size("programmes") == 0) | F.exists("programmes", lambda p: ~given(p))
    checks += [
        F.when(~in_bbox(F.col("lat"), F.col("lon")), F.concat(F.lit("Coordinates outside bounds: "), slug)),
        F.when(bad_items, F.concat(F.lit("Invalid programmes: "), slug)),
    ]
    return F.array_compact(F.array(*checks))


def validate_record(df: DataFrame, host: str, locales: Sequence[str] = vocab.LOCALES) -> DataFrame:
    return df.withColumn("errors", record_errors(host, locales))


@dataclass(frozen=True)
class DatasetRules:
    min_rows: int = vocab.MIN_ROWS
    baseline_rows: int = vocab.BASELINE_ROWS
    max_count_change_pct: float = vocab.MAX_COUNT_CHANGE_PCT
    min_complete_pct: float = vocab.MIN_COMPLETE_PCT
    max_turnover_pct: float = vocab.MAX_TURNOVER_PCT


def dataset_verdict(new: DataFrame, old: DataFrame | None, rules: DatasetRules = DatasetRules(),
                    errors: Column | None = None, key: str = "slug") -> DataFrame:
    """One row: counts, percentages, the failed rules and ``is_valid``.

    Both snapshots are reduced to per-key counters in a single shuffle; no join and no list of
    keys is built. Only active rows count, except that keys must be unique over all rows.
    """
    live = active(F.col("status"))
    n_errors = F.size(errors) if errors is not None else F.lit(0)
    complete = given(F.col("city")) & F.col("lat").isNotNull() & F.col("lon").isNotNull()

    def counters(df: DataFrame, current: bool) -> DataFrame:
        one, zero = F.lit(1), F.lit(0)
        return df.select(
            F.col(key).cast("string").alias("k"),
            (one if current else zero).alias("n_cur"),
            (live.cast("int") if current else zero).alias("a_cur"),
            (zero if current else live.cast("int")).alias("a_old"),
            ((live & complete).cast("int") if current else zero).alias("done"),
            (F.when(live, n_errors).otherwise(0) if current else zero).alias("errs"))

    rows = counters(new, True) if old is None else counters(new, True).unionByName(counters(old, False))
    per_key = rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n_cur", "a_cur", "a_old", "done", "errs")])
    named = F.coalesce(F.col("k"), F.lit("")) != ""
    totals = per_key.agg(
        F.coalesce(F.sum("a_cur"), F.lit(0)).alias("active_count"),
        F.coalesce(F.sum("a_old"), F.lit(0)).alias("previous_count"),
        F.count_if(((F.col("n_cur") > 1) & named) | ((F.col("n_cur") > 0) & ~named)).alias("duplicate_keys"),
        F.coalesce(F.sum("errs"), F.lit(0)).alias("record_errors"),
        F.coalesce(F.sum("done"), F.lit(0)).alias("complete_count"),
        F.count_if(named & (F.col("a_old") > 0)).alias("previous_keys"),
        F.count_if(named & (F.col("a_cur") > 0) & (F.col("a_old") == 0)).alias("added"),
        F.count_if(named & (F.col("a_cur") == 0) & (F.col("a_old") > 0)).alias("removed"))
    base = F.when(F.col("previous_count") > 0, F.col("previous_count")).otherwise(F.lit(rules.baseline_rows))
    count_pct = F.abs(F.col("active_count") - base) / base * 100.0
    done_pct = F.when(F.col("active_count") > 0, F.col("complete_count") / F.col("active_count") * 100.0).otherwise(F.lit(0.0))

    def turnover(name: str) -> Column:
        return F.when(F.col("previous_keys") > 0, F.col(name) / F.col("previous_keys") * 100.0).otherwise(F.lit(0.0))

    failed = F.array_compact(F.array(
        F.when(F.col("active_count") < rules.min_rows, F.lit("min_count")),
        F.when(count_pct > rules.max_count_change_pct, F.lit("count_change")),
        F.when(F.col("duplicate_keys") > 0, F.lit("key_uniqueness")),
        F.when(F.col("record_errors") > 0, F.lit("record_errors")),
        F.when(done_pct < rules.min_complete_pct, F.lit("completeness")),
        F.when(turnover("added") > rules.max_turnover_pct, F.lit("turnover_added")),
        F.when(turnover("removed") > rules.max_turnover_pct, F.lit("turnover_removed"))))
    return totals.select(
        "active_count", base.alias("base_count"), F.round(count_pct, 1).alias("count_change_pct"), "duplicate_keys",
        "record_errors", F.round(done_pct, 1).alias("complete_pct"), F.round(turnover("added"), 1).alias("added_pct"),
        F.round(turnover("removed"), 1).alias("removed_pct"), failed.alias("failed_rules"), (F.size(failed) == 0).alias("is_valid"))


def duplicate_keys(df: DataFrame, key: str = "slug") -> DataFrame:
    counted = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") > 1) | (F.col(key) == ""))


def shared_groups() -> list[tuple[str, int, str]]:
    """Rows (kind, group_id, slug) of the known shared sites and addresses."""
    named = [("site", g) for g in vocab.SHARED_SITE_GROUPS] + [("address", g) for g in vocab.SHARED_ADDRESS_GROUPS]
    return [(kind, i, slug) for i, (kind, group) in enumerate(named) for slug in group]


def shared_resources(df: DataFrame, allowed: DataFrame | None = None, key: str = "slug") -> DataFrame:
    """(kind, resource, n_keys, slug) for sites or addresses used by several active rows.

    Long form: a site shared by a third of the table stays one row per member. ``allowed``
    (kind, group_id, slug) lists member sets that are fine when they match exactly.
    """
    address = F.concat_ws("|", F.lower(F.trim("street")), F.upper(F.replace("postcode", F.lit(" "), F.lit(""))),
                          F.lower(F.trim(F.coalesce("city", F.lit("")))))
    whole = given(F.trim("street")) & given(F.replace("postcode", F.lit(" "), F.lit("")))
    pairs = F.array(F.struct(F.lit("site").alias("kind"), normalise_site(F.col("site")).alias("resource")),
                    F.struct(F.lit("address").alias("kind"), F.when(whole, address).alias("resource")))
    members = (df.where(active(F.col("status"))).select(key, F.inline(pairs)).where(given(F.col("resource")))
               .groupBy("kind", "resource", key).agg(F.count(F.lit(1)).alias("_rows")))
    sizes = members.groupBy("kind", "resource").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_rows").alias("_rows")).where("_rows > 1")
    if allowed is not None:
        wanted = allowed.groupBy("kind", "group_id").agg(F.count(F.lit(1)).alias("_size"))
        matched = (members.join(allowed.withColumnRenamed("slug", key), ["kind", key])
                   .groupBy("kind", "resource", "group_id").agg(F.count(F.lit(1)).alias("_hits"))
                   .join(wanted, ["kind", "group_id"]).where("_hits = _size").select("kind", "resource", F.col("_size").alias("n_keys")))
        sizes = sizes.join(matched, ["kind", "resource", "n_keys"], "left_anti")
    return members.select("kind", "resource", key).join(sizes.drop("_rows"), ["kind", "resource"]).select("kind", "resource", "n_keys", key)


def completeness(df: DataFrame, required: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, complete rows and percentage, optionally per group."""
    whole = F.lit(True)
    for c in required:
        whole = whole & given(F.col(c))
    total = F.count(F.lit(1))
    done = F.count_if(whole)
    frame = df.groupBy(*by) if by else df
    return frame.agg(total.alias("total"), done.alias("complete"), F.round(done / total * 100.0, 1).alias("pct"))


def missing_fields(df: DataFrame, required: Sequence[str], key: str = "slug") -> DataFrame:
    """(key, field) for every empty required field."""
    absent = F.array_compact(F.array(*[F.when(~given(F.col(c)), F.lit(c)) for c in required]))
    return df.select(key, F.explode(absent).alias("field"))


def run_report(merged: DataFrame, feed: DataFrame, diff: DataFrame) -> DataFrame:
    """(metric, value) rows of one refresh: reconciliation, difference and completeness."""
    feed_part = feed.agg(F.count(F.lit(1)).alias("total_embedded"), F.count_if(F.col("reason").isNull()).alias("active_count"),
                         F.count_if(F.col("reason").isNotNull()).alias("excluded_count"))
    diff_part = diff.agg(*[F.count_if(F.col("change") == c).alias(f"{c}_count") for c in ("added", "removed", "retained")])
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    merged_part = merged.agg(
        F.count(F.lit(1)).alias("processed_count"), F.count_if(located).alias("complete_count"),
        F.count_if(~given(F.col("city"))).alias("missing_city"), F.count_if(~located).alias("missing_coords"),
        F.round(F.count_if(located) / F.count(F.lit(1)) * 100.0, 1).alias("complete_pct"))
    wide = feed_part.crossJoin(diff_part).crossJoin(merged_part)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("decimal(18,1)").alias("value")) for c in wide.columns])
    return wide.select(F.inline(pairs))


def refresh_findings(current: DataFrame, merged: DataFrame, diff: DataFrame, excluded: DataFrame | None = None,
                     errors: Column | None = None, allowed: DataFrame | None = None, key: str = "slug") -> DataFrame:
    """(section, metric, key, detail): one row for everything a refresh has to say about a key.

    Rows of ``current`` tell sanity issues and matched overrides, those of ``merged`` empty fields and record
    errors, each in one scan; ``excluded`` holds (key, reason). Parts whose columns a table lacks are left out.
    """
    def found(section: str, metric: str, detail: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), detail.cast("string").alias("detail")))

    def listed(df: DataFrame, findings: list[Column]) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("key"), F.inline(F.array_compact(F.array(*findings)))).select("section", "metric", "key", "detail")

    none = F.lit(None)
    parts = [listed(merged, [found("geocoding_completeness", "missing_city", none, ~given(F.col("city"))),
                             found("geocoding_completeness", "missing_coords", none, F.col("lat").isNull() | F.col("lon").isNull())]),
             listed(diff.where("change <> 'retained'"), [found("diff", c, none, F.col("change") == c) for c in ("added", "restored", "removed")])]
    if errors is not None:
        wrong = merged.where(active(F.col("status"))).select(F.col(key).cast("string").alias("key"), F.explode(errors).alias("detail"))
        parts.append(wrong.select(F.lit("validation").alias("section"), F.lit("error").alias("metric"), "key", "detail"))
    if "geo_province" in current.columns:
        odd = geo_sanity(current).select(F.col(key).cast("string").alias("key"), F.explode("issues").alias("detail"))
        parts.append(odd.select(F.lit("sanity_checks").alias("section"), F.lit("issue").alias("metric"), "key", "detail"))
    if "source_matches" in current.columns:
        parts.append(listed(current, [found("overrides_status", "source_match", none, F.col("source_matches"))]))
    if excluded is not None:
        parts.append(listed(excluded, [found("reconciliation", "excluded", F.col("reason"), F.col("reason").isNotNull())]))
    places = {"site": ("museum_website", "site"), "street": ("address.street", "street"), "postcode": ("address.postcode", "postcode")}
    sources = {name: next((c for c in options if c.split(".")[0] in merged.columns), None) for name, options in places.items()}
    if all(sources.values()):
        shared = shared_resources(merged.select(key, "city", "status", *[F.col(c).alias(name) for name, c in sources.items()]), allowed, key)
        parts.append(shared.select(F.lit("shared_resources_audit").alias("section"), F.lit("warning").alias("metric"), F.col(key).cast("string").alias("key"),
                                   F.concat_ws(" ", "kind", "resource").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def refresh_report(findings: DataFrame, totals: Mapping[tuple[str, str], float | None]) -> DataFrame:
    """(section, metric, key, detail, value): the findings, their number per metric, and given totals, both without a key."""
    spark = findings.sparkSession
    rows = [(section, metric, None if value is None else float(value)) for (section, metric), value in totals.items()]
    given_ = spark.createDataFrame(rows, "section string, metric string, value double")
    counted = findings.groupBy("section", "metric").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.concat("metric", F.lit("_count")))
    empty = F.lit(None).cast("string")
    numbers = given_.unionByName(counted).select("section", "metric", empty.alias("key"), empty.alias("detail"), "value")
    return findings.withColumn("value", F.lit(None).cast("double")).unionByName(numbers)
