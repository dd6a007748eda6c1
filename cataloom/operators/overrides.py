"""Curated field overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str = "slug", city: str = "city") -> DataFrame:
    """Replace fields by key; a partial address is merged and its city also sets ``city``.

    ``overrides`` holds the key and any subset of the catalogue's columns, null meaning "not
    overridden"; a field the catalogue lacks is an error. ``source_matches`` marks rows whose
    source already says what the override says.
    """
    fields = [c for c in overrides.columns if c != key]
    unknown = sorted(set(fields) - set(df.columns))
    for name in fields:
        if name in df.columns and isinstance(df.schema[name].dataType, StructType):
            unknown += sorted(f"{name}.{p}" for p in set(overrides.schema[name].dataType.names) - set(df.schema[name].dataType.names))
    if unknown:
        raise ValueError(f"overrides of unknown fields: {', '.join(unknown)}")
    curated = overrides.select(key, F.struct(*fields).alias("_ov"))
    joined = df.join(curated, key, "left")
    matches, values = F.col("_ov").isNotNull(), {}
    for name in fields:
        kind = df.schema[name].dataType
        new, old = F.col(f"_ov.`{name}`"), F.col(name)
        if isinstance(kind, StructType):
            part_names = [p for p in overrides.schema[name].dataType.names if p in kind.names]
            merged = F.struct(*[
                (F.coalesce(new[p], old[p]) if p in part_names else old[p]).alias(p) for p in kind.names])
            values[name] = F.when(old.isNotNull() | new.isNotNull(), merged)
            for p in part_names:
                matches = matches & (new[p].isNull() | new[p].eqNullSafe(old[p]))
        else:
            values[name] = F.coalesce(new, old)
            matches = matches & (new.isNull() | new.eqNullSafe(old))
    if "address" in fields and city in df.columns and "city" in overrides.schema["address"].dataType.names:
        values[city] = F.coalesce(F.col("_ov.address.city"), values.get(city, F.col(city)))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in df.columns], matches.alias("source_matches"))
