"""Table jobs over text and page columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text, vocab

# step name -> expression on the source column
STEPS = {
    "normalise_text": text.normalise_text,
    "fold_accents": text.fold,
    "token_key": text.token_key,
    "match_norm": text.match_norm,
    "match_norm_loose": text.match_norm_loose,
    "clean_html": text.clean_html,
    "html_title": text.html_title,
    "clean_city": text.clean_city,
    "scrub_secrets": text.scrub,
    "word_count": text.word_count,
}

# page steps stage intermediate columns, so they work on the frame
PAGE_STEPS = {"visible_text": html.with_visible_text, "page_identity": html.with_identity}


def prepare_text(df: DataFrame, steps: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``out = step(source)`` columns: ``{"key": ("token_key", "name")}``."""
    done = df.withColumns({out: STEPS[step](F.col(source)) for out, (step, source) in steps.items() if step in STEPS})
    for out, (step, source) in steps.items():
        if step in PAGE_STEPS:
            done = PAGE_STEPS[step](done, source, out)
    return done


def scrub_columns(df: DataFrame, patterns=vocab.SECRET_PATTERNS) -> DataFrame:
    """Scrub every string of a table, inside arrays, structs and map values too."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructType

    def clean(value: Column, kind) -> Column:
        if isinstance(kind, StringType):
            return text.scrub(value, patterns)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, StructType):
            parts = F.struct(*[clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), parts)
        return value

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def first_pages(df: DataFrame, key: str, position: str, max_pages: int = 4) -> DataFrame:
    """The pages that go into one context text, chosen before anything is gathered."""
    from .scale import top_per_key

    return top_per_key(df, [key], [F.col(position)], max_pages, "_page")


def concat_pages(df: DataFrame, key: str, position: str, title: str, url: str, body: str, max_pages: int = 4) -> DataFrame:
    """One text per key from its first ``max_pages`` pages, in order, each under a heading."""
    pages = first_pages(df, key, position, max_pages)
    block = F.concat(F.lit("=== PAGE "), F.col("_page").cast("string"), F.lit(": "), F.col(title), F.lit(" ("),
                     F.col(url), F.lit(") ===\n"), F.col(body))
    gathered = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_page"), block.alias("b")))).alias("p"))
    return gathered.select(key, F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))
