"""Snapshot reconciliation: publish filter, soft-delete merge, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(status: Column) -> Column:
    return F.coalesce(status, F.lit("active")) != "removed"


def active_only(df: DataFrame, drop_duplicates_of: bool = False) -> DataFrame:
    rows = df.where(active(F.col("status")))
    return rows.where(F.col("duplicate_of").isNull()) if drop_duplicates_of else rows


def reconcile_published(df: DataFrame, is_startpage: str = "is_startpage", published_at: str = "published_at") -> DataFrame:
    """Add ``reason``: null for publishable rows, else why the row is left out."""
    held = F.coalesce(F.col(is_startpage), F.lit(False)) | F.nullif(F.col(published_at).cast("string"), F.lit("")).isNull()
    return df.withColumn("reason", F.when(held, "unpublished or startpage"))


def soft_delete_merge(new: DataFrame, old: DataFrame, key: str = "slug", as_of: str | None = None,
                      remove_after: int = 2) -> DataFrame:
    """New rows win with counter 0; absent old rows stay, counted, and are removed at the limit.

    One full-outer join: both snapshots are shuffled once by key. With ``as_of`` the first-seen
    date is carried from the old row, or set for entities never seen before.
    """
    fields = [c for c in old.columns if c != key]
    fresh = new.select(key, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c)
                                       for c in fields]).alias("_n"))
    prior = old.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key, F.struct(*fields).alias("_o"))
    merged = fresh.join(prior, key, "full_outer")
    present = F.col("_n").isNotNull()
    missing = F.coalesce(F.col("_o.consecutive_missing"), F.lit(0)) + 1
    gone = (missing >= remove_after) | (F.col("_o.status") == "removed")
    special = {
        "consecutive_missing": F.when(present, F.lit(0)).otherwise(missing),
        "status": F.when(present, F.coalesce("_n.status", F.lit("active"))).when(gone, "removed").otherwise("active"),
    }
    if as_of is not None and "first_seen" in fields:
        special["first_seen"] = F.when(present, F.coalesce("_o.first_seen", "_n.first_seen", F.lit(as_of).cast(old.schema["first_seen"].dataType))) \
            .otherwise(F.col("_o.first_seen"))
    return merged.select(key, *[
        special.get(c, F.when(present, F.col(f"_n.`{c}`")).otherwise(F.col(f"_o.`{c}`"))).cast(old.schema[c].dataType).alias(c)
        for c in fields])


def snapshot_order(df: DataFrame, key: str = "slug") -> DataFrame:
    return df.orderBy(~active(F.col("status")), key)


def snapshot_diff(new: DataFrame, old: DataFrame, key: str = "slug", active_keys: bool = False) -> DataFrame:
    """(key, change) with change added, removed, restored or retained; one aggregate shuffle.

    All keys are compared; with ``active_keys`` only those of active rows, so that a soft-deleted row shows as
    removed, and a key that was in the old snapshot only as removed comes back as restored.
    """
    def tag(df: DataFrame, side: str) -> DataFrame:
        live = active(F.col("status")) if active_keys and "status" in df.columns else F.lit(True)
        return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(
            key, (F.lit(side == "new") & live).cast("int").alias("n"),
            (F.lit(side == "old") & live).cast("int").alias("o"), F.lit(int(side == "old")).alias("known"))

    seen = tag(new, "new").unionByName(tag(old, "old")).groupBy(key).agg(F.max("n").alias("n"), F.max("o").alias("o"), F.max("known").alias("known"))
    change = (F.when((F.col("n") == 1) & (F.col("o") == 1), "retained").when((F.col("n") == 1) & (F.col("known") == 1), "restored")
              .when(F.col("n") == 1, "added").when(F.col("o") == 1, "removed"))
    return seen.select(key, change.alias("change")).where("change is not null")


def changelog_entry(diff: DataFrame, total: DataFrame, timestamp: str, first_run: bool = False) -> DataFrame:
    """One header row (counts) when anything was added or removed, or on a first run."""
    counts = diff.agg(F.count_if(F.col("change").isin("added", "restored")).alias("added"),
                      F.count_if(F.col("change") == "removed").alias("removed"))
    rows = counts.crossJoin(total.agg(F.count(F.lit(1)).alias("total_count")))
    stamp = F.lit(timestamp).cast("timestamp")
    entry = rows.select(F.to_date(stamp).alias("date"), stamp.alias("timestamp"), "added", "removed", "total_count")
    return entry if first_run else entry.where("added > 0 or removed > 0")
