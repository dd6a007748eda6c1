"""Evidence mining: pattern contexts, model answers, reference hits and images."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import vocab
from ..functions.text import clean_html, collapse_space, contains_any, empty_to_null
from .scale import one_per_key, top_per_key

#: Lengths summed at once; running sums of a text with many matches are made block by block.
_BLOCK = 128


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)


def with_matches(df: DataFrame, column: str, pattern: str, out: str) -> DataFrame:
    """Add the matches of ``pattern``, left to right without overlap, as structs of start (from 0, in characters) and match.

    A match starts behind the gaps and matches before it, so starts are running sums of their lengths. The
    pattern must not match the empty text; its classes are those of all letters, not of ASCII alone.
    """
    wide = F.lit("(?U)" + pattern)
    staged = df.withColumns({"_matches": F.regexp_extract_all(column, wide, F.lit(0)), "_gaps": F.split(column, wide)})
    steps = F.zip_with("_matches", F.slice("_gaps", 1, F.size("_matches")), lambda m, g: F.length(m) + F.length(g))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_matches") - 1) / _BLOCK).cast("int")), lambda k: F.slice("_steps", k * _BLOCK + 1, F.lit(_BLOCK)))
    staged = staged.withColumn("_steps", steps).withColumn("_blocks", F.when(F.size("_matches") > 0, blocks))
    staged = staged.withColumn("_sums", F.transform("_blocks", _sum))
    staged = staged.withColumn("_heads", F.transform("_sums", lambda _, k: _sum(F.slice("_sums", F.lit(1), k))))
    ends = F.flatten(F.zip_with("_blocks", "_heads", lambda block, head: F.transform(block, lambda _, i: head + _sum(F.slice(block, F.lit(1), i + 1)))))
    found = F.zip_with("_matches", ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), m.alias("match")))
    return staged.withColumn(out, F.when(F.size("_matches") > 0, found)).drop("_matches", "_gaps", "_steps", "_blocks", "_sums", "_heads")


def pattern_contexts(df: DataFrame, column: str, pattern: str = vocab.POSTCODE_ANYCASE_PATTERN,
                     width: int = 100, quote_words: int = vocab.MAX_QUOTE_WORDS) -> DataFrame:
    """One row per match with its offset, surrounding text and a short quote; texts without a match give none."""
    found = with_matches(df.where(F.col(column).rlike("(?U)" + pattern)), column, pattern, "_found")

    def window(m: Column) -> Column:
        first = F.greatest(m["start"] - width, F.lit(0))
        return collapse_space(F.substring(F.col(column), first + 1, m["start"] + F.length(m["match"]) + width - first))

    rows = F.transform("_found", lambda m: F.struct(m["start"].alias("start"), m["match"].alias("match"), window(m).alias("window")))
    quoted = F.array_join(F.slice(F.split("window", " "), 1, quote_words), " ").alias("quote")
    return found.select(*[c for c in df.columns if c != column], F.inline(rows)).select("*", quoted)


def keyword_filter(df: DataFrame, column: str, pattern: str = vocab.PRICE_PAGE_PATTERN) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


_BRACKETS = {"{": "}", "[": "]"}


def _repair(raw: str | None) -> str | None:
    """Close a cut-off object, behind its last character if that parses, else behind its last complete member.

    One scan keeps the closers of what is open; a comma outside text ends a complete member.
    """
    start = raw.find("{") if raw else -1
    if start < 0:
        return None
    owed: list[str] = []
    complete = None
    quoted = escaped = False
    for at in range(start, len(raw)):
        char = raw[at]
        if quoted:
            quoted = escaped or char != '"'
            escaped = char == "\\" and not escaped
        elif char == '"':
            quoted = True
        elif char in _BRACKETS:
            owed.append(_BRACKETS[char])
        elif char in "]}":
            if not owed or owed.pop() != char:
                break
            if not owed:
                return raw[start:at + 1]
        elif char == ",":
            complete = raw[start:at] + "".join(reversed(owed))
    whole = raw[start:] + '"' * quoted + "".join(reversed(owed))
    for text in (whole, complete):
        try:
            if text is not None and isinstance(json.loads(text), dict):
                return text
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _repair_udf(raw: pd.Series) -> pd.Series:
    return raw.map(_repair)


def parse_answers(df: DataFrame, column: str, out: str = "answer") -> DataFrame:
    """Variant object from a model's reply: as is, fenced, outermost braces, then repaired.

    Only replies that fail the three native tries reach the Arrow repair.
    """
    raw = F.trim(column)

    def as_object(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        return F.when(F.ltrim(text).startswith("{"), parsed)

    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    native = F.coalesce(as_object(raw), as_object(fenced), as_object(outer))
    staged = df.withColumn("_native", native)
    repaired = F.try_parse_json(_repair_udf(F.when(F.col("_native").isNull(), raw)))
    return staged.withColumn(out, F.coalesce(F.col("_native"), repaired)).drop("_native")


def answer_fields(df: DataFrame, column: str = "answer") -> DataFrame:
    """Typed fields of a parsed answer; ``{"value": x}`` wrappers are opened, bad numbers are null."""
    v = F.col(column)

    def text_of(name: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, "string") for p in (f"$.{name}.value", f"$.{name}.type", f"$.{name}.enum[0]", f"$.{name}")])

    def number_of(name: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{name}.value", "double"), F.try_variant_get(v, f"$.{name}", "double"))

    def amount(*names: str) -> Column:
        return F.coalesce(*[number_of(n) for n in names])

    def plain(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    return df.withColumns({
        "status": F.coalesce(text_of("status"), F.lit("unknown")),
        "confidence": text_of("confidence"),
        "primary_adult_eur": amount("primary_adult_eur", "adult_eur"),
        "door_adult_eur": amount("door_adult_eur"), "online_adult_eur": amount("online_adult_eur"), "cheapest_adult_eur": amount("cheapest_adult_eur"),
        "variants": F.try_variant_get(v, "$.variants", "map<string,double>"),
        "quote": plain("quote"), "source_url": plain("source_url"), "page_title": plain("page_title"),
        "free_for": F.coalesce(F.try_variant_get(v, "$.free_for", "array<string>"), F.array().cast("array<string>")),
        "note": F.coalesce(plain("note"), plain("notes")), "reason": F.coalesce(plain("reasoning_summary"), plain("reasoning"), plain("reason")),
    })


def pick_reference(hits: DataFrame, snippet_words: Sequence[str] = vocab.REFERENCE_SNIPPET_KEYWORDS,
                   title_words: Sequence[str] = vocab.REFERENCE_TITLE_KEYWORDS) -> DataFrame:
    """hits(slug, query_pos, rank, title, snippet) -> first acceptable title per entity."""
    good = contains_any(F.lower("snippet"), snippet_words) | contains_any(F.lower("title"), title_words)
    kept = hits.where(good).select("slug", "query_pos", "rank", "title")
    return one_per_key(kept, ["slug"], F.struct("query_pos", "rank"), newest=False)


def pick_images(images: DataFrame, limit: int = 3) -> DataFrame:
    """images(slug, pos, file, ...) -> up to ``limit`` distinct photographs per entity."""
    name = F.trim(F.replace(F.replace("file", F.lit("Bestand:"), F.lit("")), F.lit("File:"), F.lit("")))
    photo = images.withColumn("file", name).withColumn("_low", F.lower("file"))
    ends = F.lit(False)
    for ext in vocab.IMAGE_EXTENSIONS:
        ends = ends | F.col("_low").endswith(ext)
    photo = photo.where(ends & ~contains_any(F.col("_low"), vocab.IMAGE_EXCLUSIONS))
    unique = one_per_key(photo, ["slug", "_low"], F.col("pos"), newest=False).drop("_low")
    if {"author", "credit"} <= set(images.columns):
        unique = unique.withColumn("credit_line", image_credit(F.col("author"), F.col("credit")))
    return top_per_key(unique, ["slug"], [F.col("pos"), F.col("file")], limit)


def image_credit(author: Column, credit: Column) -> Column:
    """Author without markup; long lists keep the first name, unknown authors use the credit."""
    name = clean_html(F.coalesce(author, F.lit("Unknown")))
    name = F.when(F.length(name) > 60, F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(name)
    other = F.left(clean_html(F.coalesce(credit, F.lit("Wikimedia Commons"))), F.lit(60))
    chosen = F.when((name == "") | F.lower(name).isin("unknown", "onbekend"), other).otherwise(name)
    return F.coalesce(empty_to_null(chosen), F.lit("Wikimedia Commons"))
