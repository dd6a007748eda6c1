"""Wrapped JSON documents, nested feeds, keyed stores and lookup files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.scale import one_per_key

FEED_COMPONENTS = ("all-articles", "article-overview")


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, doc) of JSON documents as VARIANT, one per file or, without ``multi_line``, one per line.

    No schema is laid over a document, so its parts are read where they are asked for. A document that cannot
    be read, also one that names a key twice in one object, is null. A missing path is an empty table.
    """
    try:
        docs = spark.read.option("singleVariantColumn", "doc").option("multiLine", multi_line).json(path)
        return docs.select(F.col("_metadata.file_path").alias("file"), "doc")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return spark.createDataFrame([], "file string, json string").select("file", F.parse_json("json").alias("doc"))
        raise


def _rows(docs: DataFrame, items: Column, schema: StructType) -> DataFrame:
    """One row per item of the VARIANT array, with its place ``pos``; a value of another type is null."""
    rest = [c for c in docs.columns if c != "doc"]
    listed = docs.select(*rest, items.alias("_items"))
    exploded = listed.lateralJoin(listed.sparkSession.tvf.variant_explode(F.col("_items").outer()))
    fields = [F.try_variant_get("value", f'$["{f.name}"]', f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    return exploded.where("key is null").select(*rest, F.col("pos"), *fields)


def read_wrapped(spark: SparkSession, path: str, field: str, schema: StructType, multi_line: bool = True, positions: bool = False) -> DataFrame:
    """Rows of ``{..., field: [row, ...]}`` documents; with ``positions`` also their file and place, from 0.

    Files are dealt over tasks; use ``multi_line=False`` for one document per line, which Spark can split.
    """
    docs = read_documents(spark, path, multi_line)
    rows = _rows(docs, F.try_variant_get("doc", f'$["{field}"]', "variant"), schema)
    return rows if positions else rows.select(*schema.names)


def read_wrapped_or_list(docs: DataFrame, column: str, field: str, schema: StructType) -> DataFrame:
    """Rows of documents that are a bare list or ``{field: [...]}``, with the other columns of ``docs``."""
    rest = [c for c in docs.columns if c != column]
    parsed = docs.select(*rest, F.try_parse_json(column).alias("doc"))
    bare = F.try_variant_get("doc", "$[0]", "variant").isNotNull()
    items = F.when(bare, F.col("doc")).otherwise(F.try_variant_get("doc", f'$["{field}"]', "variant"))
    return _rows(parsed, items, schema).select(*rest, *schema.names)


def read_keyed(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key, the last one listed; rows without a key drop out."""
    return one_per_key(df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key], F.col(pos))


def load_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(alias, display) from a flat ``alias: display`` file, quotes and comments allowed."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return spark.createDataFrame([], "alias string, display string")
        raise
    pattern = r"""^\s*(?:"([^"]*)"|'((?:[^']|'')*)'|([^#:'"][^:]*?))\s*:\s+(?:"([^"]*)"|'((?:[^']|'')*)'|([^#'"].*?))\s*$"""

    def part(*groups: int) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("value", pattern, g), F.lit("")) for g in groups])

    return lines.where(F.col("value").rlike(pattern)).select(part(1, 2, 3).alias("alias"), part(4, 5, 6).alias("display"))


def load_overrides(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Curated overrides as JSON lines ``{"slug": ..., field: value, ...}``; a missing file is empty."""
    return _read(spark, path, schema, False)


def article_schema() -> StructType:
    named = StructType([StructField("name", StringType())])
    return StructType([
        StructField("slug", StringType()), StructField("name", StringType()), StructField("is_startpage", StringType()),
        StructField("published_at", StringType()), StructField("first_published_at", StringType()), StructField("created_at", StringType()),
        StructField("content", StructType([StructField("tags", ArrayType(named))]))])


def feed_articles(body: Column, components: Sequence[str] = FEED_COMPONENTS) -> Column:
    """Articles of the first listing component in the last content area that has one.

    ``body`` is array<struct<contentAreas: array<struct<content: array<struct<component,
    articles>>>>>>. Works inside the row, so nested feeds never shuffle.
    """
    def listing(area: Column) -> Column:
        return F.get(F.filter(area["content"], lambda c: c["component"].isin(*components)), F.lit(0))

    areas = F.flatten(F.transform(body, lambda b: b["contentAreas"]))
    found = F.filter(F.transform(areas, listing), lambda c: c.isNotNull())
    return F.try_element_at(found, F.lit(-1))["articles"]


def read_feed(feeds: DataFrame, body: str = "body", components: Sequence[str] = FEED_COMPONENTS) -> DataFrame:
    """One row per feed article, with its position; feeds without a listing give no rows."""
    rest = [c for c in feeds.columns if c != body]
    return feeds.select(*rest, F.posexplode(feed_articles(F.col(body), components)).alias("pos", "article"))


def parse_story(articles: DataFrame, story: str = "article") -> DataFrame:
    """Factual fields of a story: province is the first tag, the date the first published or created."""
    s = F.col(story)
    return articles.select(
        s["slug"].alias("slug"), F.trim(F.coalesce(s["name"], F.lit(""))).alias("name"),
        F.trim(F.coalesce(F.get(s["content"]["tags"], F.lit(0))["name"], F.lit(""))).alias("province"),
        F.coalesce(F.nullif(s["first_published_at"], F.lit("")), s["created_at"]).alias("source_date_raw"),
        (F.lower(F.coalesce(s["is_startpage"], F.lit("false"))) == "true").alias("is_startpage"), s["published_at"].alias("published_at"))
