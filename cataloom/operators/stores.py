"""Keyed stores: accepted prices, review queue, proposals, ratings, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from .scale import one_per_key


def _replace(store: DataFrame, updates: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Store without updated or dropped keys, plus the updates."""
    touched = updates.select(key).unionByName(drop.select(key))
    return store.join(touched, key, "left_anti").unionByName(updates)


def _like(rows: DataFrame, store: DataFrame, given: dict[str, Column]) -> DataFrame:
    """``rows`` in the columns of ``store``: from ``given``, null where nothing is given."""
    return rows.select(*[given.get(c, F.lit(None)).cast(store.schema[c].dataType).alias(c) for c in store.columns])


def record_results(results: DataFrame, prices: DataFrame, review: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Apply results in order: accepted rows go to prices and leave review, rejected the reverse.

    results(key, seq, is_accepted, entered_by and the columns of the stores); a stored row is
    made of the result's columns that the store has, so whole records are kept. Once a key is entered by hand only manual
    results change it, and a manual price is never deleted. Every key's final state follows
    from three of its results (last, last manual, last accepted manual), found in one aggregate.
    """
    carried = [c for c in results.columns if c not in (key, "seq")]
    row = F.struct(*carried)
    by_hand = F.coalesce(F.col("entered_by") == "manual", F.lit(False))
    seq = F.col("seq")
    last = results.groupBy(key).agg(
        F.max_by(row, seq).alias("_any"),
        F.max_by(row, F.when(by_hand, seq)).alias("_manual"),
        F.max_by(row, F.when(by_hand & F.col("is_accepted"), seq)).alias("_kept"))
    stored = prices.where("entered_by = 'manual'").select(key, F.lit(True).alias("_held"))
    state = last.join(stored, key, "left")
    locked = F.coalesce("_held", F.lit(False)) | F.col("_kept").isNotNull()
    state = state.withColumn("_locked", locked).withColumn("_last", F.when(F.col("_locked"), F.col("_manual")).otherwise(F.col("_any")))
    state = state.where("_last is not null")
    accepted = state.withColumn("_row", F.when(F.col("_last.is_accepted"), F.col("_last")).otherwise(F.col("_kept"))).where("_row is not null")
    fields = lambda of: {key: F.col(key), **{c: F.col(f"{of}.`{c}`") for c in carried}}
    new_prices = _like(accepted, prices, fields("_row"))
    rejected = state.where(~F.col("_last.is_accepted"))
    dropped = rejected.where(~F.col("_locked"))
    new_review = _like(rejected, review, fields("_last"))
    cleared = state.where(F.col("_last.is_accepted"))
    return _replace(prices, new_prices, dropped, key), _replace(review, new_review, cleared, key)


def save_agreed(results: DataFrame, prices: DataFrame, review: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """As record_results for agreed pairs: hand-entered keys and waiting results are skipped,
    and acceptance also needs high or medium confidence (or a blocked page).

    results(key, seq, status, confidence, is_accepted, disagreement_type and the columns of the
    stores); a stored row is made of the result's columns that the store has.
    """
    waiting = ("retry_later", "quota_exhausted")
    held = prices.where("entered_by = 'manual'").select(key)
    usable = results.where(~F.coalesce(F.col("status").isin(*waiting), F.lit(False)) & ~F.coalesce(F.col("disagreement_type").isin(*waiting), F.lit(False)))
    last = one_per_key(usable, [key], F.col("seq")).join(held, key, "left_anti")
    sure = F.col("is_accepted") & (F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False)) | (F.col("status") == "blocked_by_bot_protection"))
    last = last.withColumn("_ok", F.coalesce(sure, F.lit(False)))
    given = {c: F.col(c) for c in last.columns}
    accepted = _like(last.where("_ok"), prices, given | {"entered_by": F.lit(None)})
    rejected = last.where(~F.col("_ok"))
    to_review = _like(rejected, review, given | {"disagreement_type": F.coalesce(F.nullif("disagreement_type", F.lit("")), F.lit("unknown_disagreement"))})
    return _replace(prices, accepted, rejected, key), _replace(review, to_review, accepted, key)


def upsert_latest(store: DataFrame, updates: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Updates win over the store, the last update wins among updates; rows without a key drop out."""
    both = store.withColumn(seq, F.lit(None).cast("bigint")).unionByName(updates)
    keyed = both.where(" and ".join(f"{k} is not null and {k} <> ''" for k in keys))
    order = F.struct(F.col(seq).isNotNull(), F.col(seq))
    return one_per_key(keyed, keys, order).drop(seq)


def clear_matching(store: DataFrame, **match: str | None) -> DataFrame:
    """Add ``removed``: true for rows matching all given values (no value given matches all)."""
    hit = F.lit(True)
    for column, value in match.items():
        if value is not None:
            hit = hit & F.coalesce(F.col(column) == value, F.lit(False))
    return store.withColumn("removed", hit)


def typed_rating(raw: DataFrame, names: DataFrame, key: str = "slug", source: str = "Google") -> DataFrame:
    """raw(key, rating, reviews_count as text) with numbers typed, counts defaulting to 0 and names filled in."""
    joined = raw.where(f"{key} is not null and {key} <> ''").join(names.select(key, F.col("name").alias("_name")), key, "left")
    return joined.select(key, F.coalesce("_name", key).alias("name"), F.col("rating").try_cast("double").alias("rating"),
                         F.coalesce(F.col("reviews_count").try_cast("int"), F.lit(0)).alias("reviews_count"), F.lit(source).alias("source"),
                         *[c for c in raw.columns if c not in (key, "rating", "reviews_count")])


def allowed_or_default(items: Column, allowed: Sequence[str] = vocab.CATEGORIES, default: str = vocab.DEFAULT_CATEGORY) -> Column:
    kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isin(*allowed))
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def add_new(store: DataFrame, updates: DataFrame, key: str = "slug", force: bool = False) -> DataFrame:
    """Keep existing rows and add unseen ones; ``force`` lets updates replace existing rows."""
    if force:
        return store.join(updates.select(key), key, "left_anti").unionByName(updates)
    return store.unionByName(updates.join(store.select(key), key, "left_anti"))
