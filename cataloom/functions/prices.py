"""Price forms, bands and proportion intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def money(c: Column) -> Column:
    return c.cast("decimal(9,2)")


def price_literals(price: Column) -> Column:
    """The ways a page may write an amount: 12.50 12,50 12.5 12,5, and 12 12,- 12- if whole."""
    full = money(price).cast("string")
    short = F.regexp_replace(full, r"\.?0+$", "")
    comma = [F.replace(x, F.lit("."), F.lit(",")) for x in (full, short)]
    whole = F.when(full.endswith(".00"), short)
    every = F.array(full, comma[0], short, comma[1], F.concat(whole, F.lit(",-")), F.concat(whole, F.lit("-")))
    return F.array_distinct(F.array_compact(every))


def price_in_text(text: Column, price: Column, compat: bool = True) -> Column:
    """Does the text hold one of the ways to write the amount? Without ``compat`` whole numbers are compared,
    so that 5 is not found in 15."""
    literals = price_literals(price)
    if compat:
        return F.exists(literals, lambda lit: F.contains(text, lit))
    stated = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return F.arrays_overlap(stated, literals)


def sort_price(status: Column, price: Column) -> Column:
    return F.when(status == "free", F.lit(0).cast("decimal(9,2)")).when(status == "paid", money(price))


def price_band(status: Column, price: Column) -> Column:
    return (F.when((status == "free") | (price == 0), "free")
            .when((price > 0) & (price < 10), "under-10")
            .when((price >= 10) & (price < 15), "10-15")
            .when((price >= 15) & (price < 20), "15-20")
            .when(price >= 20, "20-plus"))


def map_vocab(items: Column, allowed: Sequence[str] = vocab.FREE_FOR, other: str = "other") -> Column:
    """Lower-case, underscore and map each item into a closed vocabulary, as a sorted set."""
    keys = F.transform(items, lambda x: F.replace(F.trim(F.lower(x)), F.lit(" "), F.lit("_")))
    return F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.when(k.isin(*allowed), k).otherwise(other))))


def wilson_interval(k: Column, n: Column, z: float = vocab.WILSON_Z95) -> Column:
    """struct(low, high) in percent with one decimal; no trials gives (0, 100)."""
    n, z2 = n.cast("double"), z * z
    p = k / n
    denom = 1 + z2 / n
    center = (p + z2 / (2 * n)) / denom
    margin = (z / denom) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.round(F.greatest(F.lit(0.0), center - margin) * 100, 1)
    high = F.round(F.least(F.lit(1.0), center + margin) * 100, 1)
    some = n > 0
    return F.struct(F.when(some, low).otherwise(0.0).alias("low"), F.when(some, high).otherwise(100.0).alias("high"))
