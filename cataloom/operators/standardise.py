"""Lookup-table standardisation of vocabulary and place names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_text
from .scale import one_per_key


def lookup_table(aliases: DataFrame | None, controlled: DataFrame | None) -> DataFrame:
    """(term, display): alias rows (alias, display) win over the controlled values (value)."""
    parts = []
    if aliases is not None:
        parts.append(aliases.select(F.lower("alias").alias("term"), F.col("display"), F.lit(0).alias("_prio")))
    if controlled is not None:
        parts.append(controlled.select(F.lower("value").alias("term"), F.col("value").alias("display"), F.lit(1).alias("_prio")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return one_per_key(rows, ["term"], F.struct("_prio", "display"), newest=False).drop("_prio")


def resolve_term(df: DataFrame, column: str, lookup: DataFrame, out: str | None = None) -> DataFrame:
    """Case-insensitive replacement through a (term, display) table; unknown text is kept.

    No broadcast is forced: Spark broadcasts the table when its measured size allows and
    otherwise splits hot terms in a skew join.
    """
    cleaned = df.withColumn("_clean", normalise_text(F.col(column))).withColumn("_term", F.lower("_clean"))
    joined = cleaned.join(lookup.withColumnRenamed("term", "_term"), "_term", "left")
    value = F.coalesce(F.col("display"), F.col("_clean"))
    return joined.withColumn(out or column, value).drop("_clean", "_term", "display")


def alias_list(df: DataFrame, city: str, other_name: str, aliases: DataFrame) -> DataFrame:
    """Per distinct (city, other name): the joined list of names that city is also known by."""
    pairs = df.select(F.col(city).alias("city"), F.col(other_name).alias("other")).distinct()
    key = F.lower(F.trim(F.coalesce("city", F.lit(""))))
    both = aliases.select(F.lower(F.trim("display")).alias("_k"), F.col("alias").alias("name"), F.lit(1).alias("ord")).unionByName(
        aliases.select(F.lower(F.trim("alias")).alias("_k"), F.col("display").alias("name"), F.lit(2).alias("ord")))
    # An alias table names a place a handful of times, so gathering per place stays small.
    known = both.groupBy("_k").agg(F.array_sort(F.collect_set(F.struct("ord", "name"))).alias("_known"))
    own = F.when(F.nullif("other", F.lit("")).isNotNull() & ~F.col("other").eqNullSafe(F.col("city")), F.array("other"))
    names = F.concat(F.coalesce(own, F.array().cast("array<string>")),
                     F.coalesce(F.transform("_known", lambda x: x["name"]), F.array().cast("array<string>")))
    return (pairs.withColumn("_k", key).join(known, "_k", "left")
            .select("city", "other", F.array_join(names, ", ").alias("aliases")))
