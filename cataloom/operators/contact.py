"""Address and site from rich-text paragraphs, narrow (no shuffle)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import vocab
from ..functions.geo import extract_postcode
from ..functions.text import clean_city, empty_to_null
from ..functions.urls import is_external

_STRICT = r"(?s)^(.*?)\b([1-9]\d{3})\s*([A-Z]{2})\b(.*)$"
_LOOSE = r"(?s)^(.*?)\b(\d{3,4})\s*([A-Z]{2})\b(.*)$"


PARAGRAPHS = ArrayType(StructType([StructField("text", StringType()), StructField("links", ArrayType(StringType()))]))


def _members(value, wanted: type) -> list:
    return [x for x in value if isinstance(x, wanted)] if isinstance(value, list) else []


def _line(child: dict) -> str:
    kind = child.get("type")
    return "\n" if kind == "hard_break" else str(child.get("text") or "") if kind == "text" else ""


def _hrefs(child: dict) -> list[str]:
    attrs = [m.get("attrs") for m in _members(child.get("marks"), dict) if m.get("type") == "link"] if child.get("type") == "text" else []
    found = [x.get("href") for x in attrs if isinstance(x, dict)]
    return [h for h in found if isinstance(h, str) and h]


def _walk(document: str | None) -> list[tuple[str, list[str]]] | None:
    """All paragraph nodes of a JSON document in order, under whatever keys and however deep.

    The nodes still to visit are kept in a list, so depth is not bounded by the call stack.
    """
    try:
        waiting = [json.loads(document)] if document else []
    except (ValueError, RecursionError):
        return None
    found = []
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict) and node.get("type") == "paragraph":
            children = _members(node.get("content"), dict)
            found.append(("".join(map(_line, children)), [h for c in children for h in _hrefs(c)]))
        elif isinstance(node, (dict, list)):
            waiting.extend(reversed(list(node.values() if isinstance(node, dict) else node)))
    return found


@F.pandas_udf(PARAGRAPHS)
def paragraphs(documents: pd.Series) -> pd.Series:
    """Array of struct(text, links) of all paragraph nodes of a JSON text; null where it does not parse."""
    return documents.map(_walk)


def contact_block(df: DataFrame, column: str, compat: bool = True) -> DataFrame:
    """Add street, postcode, city and site read from the first paragraph holding a postcode.

    ``compat`` only takes the city from the following line when that line looks internal,
    as the literal rule says; by default any following line that is not a URL is used.
    """
    def lines(body: Column) -> Column:
        return F.filter(F.transform(F.split(body, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    staged = df.withColumn("_ps", F.transform(column, lambda p: F.struct(lines(p["text"]).alias("lines"), p["links"].alias("links"))))
    staged = staged.withColumn("_ps", F.transform("_ps", lambda p: F.struct(
        p["lines"].alias("lines"), p["links"].alias("links"),
        F.array_position(F.transform(p["lines"], lambda x: x.rlike(vocab.POSTCODE_FALLBACK_PATTERN)), F.lit(True)).cast("int").alias("at"))))
    staged = staged.withColumn("_hit", F.get(F.filter("_ps", lambda p: p["at"] > 0), F.lit(0)))
    at, rows = F.col("_hit.at"), F.col("_hit.lines")
    staged = staged.withColumns({
        "_line": F.get(rows, at - 1), "_prev": F.get(rows, at - 2), "_next": F.get(rows, at)})
    line = F.col("_line")
    strict = line.rlike(vocab.POSTCODE_PATTERN)
    before, after = [F.trim(F.when(strict, F.regexp_extract(line, _STRICT, i)).otherwise(F.regexp_extract(line, _LOOSE, i))) for i in (1, 4)]
    usable_next = ~is_external(F.col("_next")) if compat else ~F.col("_next").rlike(r"(?i)^(https?:|www\.)")
    city = F.when(after != "", clean_city(after)).when(usable_next, clean_city(F.col("_next")))
    street = F.when(before.rlike(r"\d"), before).when(F.lower("_prev") != "contact", F.col("_prev"))
    outside = F.filter(F.flatten(F.transform("_ps", lambda p: p["links"])), lambda x: is_external(x))
    own = F.filter(F.col("_hit.links"), lambda x: is_external(x))
    site = F.coalesce(F.get(own, F.lit(0)), F.get(outside, F.lit(0)))
    return staged.withColumns({
        "street": empty_to_null(street), "postcode": extract_postcode(line),
        "city": empty_to_null(city), "site": site,
    }).drop("_ps", "_hit", "_line", "_prev", "_next")
