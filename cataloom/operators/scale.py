"""Shapes shared by the operators so that one hot key never lands in one task.

* picking one row per key is an aggregate (combined before the shuffle), never a full window;
* the first n rows per key use a limited window, which Spark also cuts before the shuffle;
* complete ranks inside a key come from a range-partitioned sort (``rank_rows``), so a key holding
  a third of the table is spread over many tasks, however its positions are spaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column, newest: bool = True) -> DataFrame:
    """The row with the greatest (or least) ``order`` per key, columns as given."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = F.max_by if newest else F.min_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return chosen.select(*[F.col(k) if k in keys else F.col(f"_row.`{k}`").alias(k) for k in df.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key; each map task forwards at most ``n`` rows of a key."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= n)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating null as a value; key columns are kept once, from the left."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def rank_rows(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based rank over the whole table, or inside ``keys``, without a single-task window.

    A distributed sort is written once to the shared folder with each row's task and position;
    ranks follow from the sizes of the runs before it. End ``order`` with a unique column so
    that equal values can be split between tasks.
    """
    ordered = df.orderBy(*[F.col(k) for k in keys], *order)
    stored = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    stored = (stored.withColumn("_task", F.shiftright("_id", 33))
              .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))
    by = ["_task", *keys]
    earlier = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    runs = (stored.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    return (null_safe(stored, runs, by)
            .withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
            .drop("_id", "_task", "_pos", "_first", "_n", "_before"))


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a frame that is one row by construction (a global aggregate)."""
    return df.join(F.broadcast(one_row), F.lit(True), "left")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """Order-independent fingerprint: row count, xor and sum of row hashes in one pass."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (columns or sorted(df.columns))]
    line = F.concat_ws("\u0001", *texts)
    digest = F.conv(F.left(F.md5(line), F.lit(12)), 16, 10).cast("bigint") if portable else F.xxhash64(line)
    hashed = df.select(digest.alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).cast("bigint").alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"),
    )
