"""Proposals: better websites and corrected addresses, backed by page evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import contains_any, distinctive_tokens, fold
from ..functions.urls import site_root
from .gates import identity_status
from .scale import one_per_key


def website_proposals(candidates: DataFrame, checked_on: str, compat: bool = True) -> DataFrame:
    """candidates(slug, name, city, rank, url, identity) -> first confirmed site per entity.

    A page counts when it matches the identity check and mentions the name together with the
    city or a word of the trade.
    """
    checked = identity_status(candidates, "name", "city", "identity", compat).where("identity_status in ('match', 'weak_match')")
    p = F.col("identity")
    text = fold(F.concat_ws(" ", p["title"], p["h1"], p["meta_description"], p["body_preview"]))
    staged = checked.withColumn("_text", text).withColumn("_name", distinctive_tokens(F.col("name"))).withColumn("_city", distinctive_tokens(F.coalesce("city", F.lit(""))))
    named = F.exists("_name", lambda t: F.contains(F.col("_text"), t))
    placed = F.exists("_city", lambda t: F.contains(F.col("_text"), t)) | contains_any(F.col("_text"), vocab.CULTURE_KEYWORDS)
    kept = staged.where(named & placed)
    quote = F.left(F.regexp_replace(F.concat_ws(" | ", p["title"], p["h1"]), r"^[ |]+|[ |]+$", ""), F.lit(100))
    proposals = kept.select(
        "slug", F.lit("website").alias("field"), "rank", site_root(F.col("url"), F.col("slug"), vocab.DEEP_LINK_KEYS).alias("proposed_value"),
        F.col("url").alias("evidence_url"), quote.alias("quote"),
        F.when(F.col("identity_status") == "match", "high").otherwise("medium").alias("confidence"), F.lit(checked_on).cast("date").alias("checked_on"))
    return one_per_key(proposals, ["slug"], F.col("rank"), newest=False).drop("rank")


def address_proposals(catalog: DataFrame, contexts: DataFrame, checked_on: str) -> DataFrame:
    """catalog(slug, postcode) and contexts(slug, page_rank, url, start, match, quote) of contact
    pages -> the first differing postcode per entity, pages in path order."""
    found = F.upper(F.replace("match", F.lit(" "), F.lit("")))
    stored = F.upper(F.replace("postcode", F.lit(" "), F.lit("")))
    joined = contexts.join(catalog.select("slug", "postcode"), "slug").where((F.coalesce(stored, F.lit("")) != "") & (stored != found))
    rows = joined.select("slug", F.lit("address").alias("field"), F.struct("page_rank", "start").alias("_o"), F.col("postcode").alias("current_value"),
                         F.regexp_replace(found, r"^(\d{4})", "$1 ").alias("proposed_value"), F.col("url").alias("evidence_url"), "quote",
                         F.lit("high").alias("confidence"), F.lit(checked_on).cast("date").alias("checked_on"))
    return one_per_key(rows, ["slug"], F.col("_o"), newest=False).drop("_o")


def field_discrepancy(left: DataFrame, right: DataFrame, key: str, field: str, tolerance: str = "0.01") -> DataFrame:
    """Keys whose value differs between two sources by more than ``tolerance``."""
    joined = left.select(key, F.col(field).alias("current_value")).join(right.select(key, F.col(field).alias("proposed_value")), key)
    return joined.where(F.abs(F.col("current_value") - F.col("proposed_value")) > F.lit(tolerance).cast("decimal(18,2)"))
