"""Rechecking stored evidence against a fetch log, staleness and target selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.urls import extract_domain, path, same_or_subdomain
from .snapshot import active


def source_verdict(df: DataFrame, pattern: str = vocab.PRICE_PAGE_PATTERN) -> DataFrame:
    """Add ``failure``: first reason why a stored source no longer holds, null when it does.

    Rows: source_url, website, http_status, final_url, body.
    """
    url = F.trim("source_url")
    base = extract_domain(F.coalesce(F.nullif("website", F.lit("")), url))
    deep = F.length(F.regexp_replace(path(url), "/+$", "")) > 1
    at_root = F.regexp_replace(path(F.col("final_url")), "/+$", "") == ""
    failure = (F.when(F.coalesce(F.col("source_url"), F.lit("")) == "", "missing source_url")
               .when(~url.rlike("^https?://"), "invalid scheme")
               .when(~F.coalesce(F.col("http_status") == 200, F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("error"))))
               .when((base != "") & ~same_or_subdomain(F.col("final_url"), base), "redirected to external domain")
               .when(deep & at_root, "redirected to homepage root")
               .when(~F.coalesce(F.col("body").rlike(pattern), F.lit(False)), "no pricing keywords"))
    return df.withColumn("failure", failure)


def older_than(ts: Column, as_of: Column, days: int) -> Column:
    return ts < as_of - F.expr(f"interval {days} days")


def needs_refetch(log: DataFrame, as_of: Column, days: int = vocab.REFETCH_AFTER_DAYS, ts: str = "fetched_at") -> DataFrame:
    return log.where(older_than(F.col(ts), as_of, days))


def staleness(df: DataFrame, as_of: Column, ts: str = "last_checked", days: int = vocab.STALE_AFTER_DAYS) -> DataFrame:
    return df.withColumn("is_stale", F.coalesce(older_than(F.col(ts), as_of, days), F.lit(False)))


def enrichment_targets(catalog: DataFrame, store: DataFrame, as_of: Column, resume: bool = False, only_stale: bool = False,
                       interval_days: int = vocab.REFRESH_INTERVAL_DAYS, key: str = "slug") -> DataFrame:
    """Active entities to work on: all, those not in the store, or those missing or out of date."""
    rows = catalog.where(active(F.col("status")))
    if resume:
        rows = rows.join(store.select(key).distinct(), key, "left_anti")
    if only_stale:
        fresh = store.where(~older_than(F.col("checked_on"), as_of, interval_days)).select(key).distinct()
        rows = rows.join(fresh, key, "left_anti")
    return rows
