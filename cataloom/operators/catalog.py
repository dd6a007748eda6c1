"""The queryable catalogue: joined view, search, facets, bands and ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.geo import haversine_km
from ..functions.prices import price_band, sort_price
from ..functions.text import fold
from .snapshot import active


def canonicalise(df: DataFrame, mapping: DataFrame, column: str = "slug") -> DataFrame:
    """Replace a key by its canonical one; mapping(slug, duplicate_of) has one row per slug."""
    renamed = mapping.where("duplicate_of is not null").select(F.col("slug").alias(column), "duplicate_of")
    joined = df.join(renamed, column, "left")
    return joined.select(*[F.coalesce("duplicate_of", column).alias(c) if c == column else F.col(c) for c in df.columns])


def catalog_view(catalog: DataFrame, prices: DataFrame, descriptions: DataFrame, ratings: DataFrame,
                 keep_duplicates: bool = False) -> DataFrame:
    """Active rows with price, categories and rating; a duplicate borrows its canonical row's.

    The three side tables are first put together by key, so the catalogue joins them once on
    its own key and, when duplicates are kept, once on the canonical key. Folded search
    columns are part of the view so that later text filters compare plain strings.
    """
    rows = catalog.where(active(F.col("status")))
    if not keep_duplicates:
        rows = rows.where(F.col("duplicate_of").isNull())
    price = prices.select("slug", F.struct("status", "price").alias("_price"))
    text = descriptions.select("slug", F.struct("categories").alias("_text"))
    score = ratings.select("slug", F.struct("rating", "reviews").alias("_score"))
    side = price.join(text, "slug", "full_outer").join(score, "slug", "full_outer")
    joined = rows.join(side, "slug", "left")
    if keep_duplicates:
        # Only duplicates look for another row; all others have a null there and stay out of the join.
        names = joined.columns
        canon = side.select(F.col("slug").alias("duplicate_of"), *[F.col(c).alias(f"{c}_c") for c in ("_price", "_text", "_score")])
        copies = joined.where("duplicate_of is not null").join(canon, "duplicate_of", "left")
        for c in ("_price", "_text", "_score"):
            copies = copies.withColumn(c, F.coalesce(c, f"{c}_c"))
        joined = joined.where("duplicate_of is null").unionByName(copies.select(*names))
    view = joined.select(
        *[F.col(c) for c in rows.columns if c != "status"],
        F.coalesce("_price.status", F.lit("unknown")).alias("price_status"),
        sort_price(F.col("_price.status"), F.col("_price.price")).alias("price"),
        F.coalesce("_text.categories", F.array().cast("array<string>")).alias("categories"),
        F.col("_score.rating").alias("rating"), F.coalesce("_score.reviews", F.lit(0)).alias("reviews"))
    return with_search_columns(view)


def with_search_columns(df: DataFrame) -> DataFrame:
    """Folded copies of the searched columns that the frame has."""
    folded = [c for c in ("name", "city", "gazetteer_city", "aliases", "province", "street", "postcode") if c in df.columns]
    return df.withColumns({f"{c}_folded": F.coalesce(fold(F.col(c)), F.lit("")) for c in folded})


def _resolve_alias(query: Column, aliases: Mapping[str, str]) -> Column:
    resolved = query
    for alias, display in reversed(list(aliases.items())):
        resolved = F.when(query == fold(F.lit(alias)), fold(F.lit(display))).otherwise(resolved)
    return resolved


def search(df: DataFrame, query: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Accent- and alias-insensitive substring search over a frame with search columns."""
    folded = fold(F.lit(query))
    alias = _resolve_alias(folded, aliases or {})
    hit = F.coalesce(folded, F.lit("")) == ""
    for c in ("name", "city", "gazetteer_city", "aliases"):
        if f"{c}_folded" in df.columns:
            hit = hit | F.contains(F.col(f"{c}_folded"), folded) | F.contains(F.col(f"{c}_folded"), alias)
    for c in ("province", "street", "postcode"):
        if f"{c}_folded" in df.columns:
            hit = hit | F.contains(F.col(f"{c}_folded"), folded)
    return df.where(hit)


def facet_filter(df: DataFrame, province: str | None = None, city: str | None = None,
                 categories: Sequence[str] = (), hide_visited: bool = False) -> DataFrame:
    keep = F.lit(True)
    if province:
        keep = keep & (F.col("province") == province)
    if city:
        keep = keep & (F.col("city") == city)
    if categories:
        keep = keep & F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories]))
    if hide_visited:
        keep = keep & ~F.coalesce(F.col("visited"), F.lit(False))
    return df.where(keep)


def band_filter(df: DataFrame, band: str | None) -> DataFrame:
    return df if not band else df.where(price_band(F.col("price_status"), F.col("price")) == band)


def min_score(df: DataFrame, rating: float = 0.0, reviews: int = 0) -> DataFrame:
    """A missing rating fails any minimum; missing review counts are zero."""
    if rating > 0:
        df = df.where(F.col("rating") >= rating)
    if reviews > 0:
        df = df.where(F.coalesce(F.col("reviews"), F.lit(0)) >= reviews)
    return df


def with_distance(df: DataFrame, lat: float, lon: float, max_km: float | None = None) -> DataFrame:
    near = df.withColumn("distance", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    return near if max_km is None else near.where(F.col("distance") <= max_km)


def sort_keys(name: str) -> list[Column]:
    """Ordering of one named key; unknown ratings and prices come last either way."""
    rating, reviews = F.col("rating"), F.coalesce(F.col("reviews"), F.lit(0))
    return {
        "distance": lambda: [F.coalesce(F.col("distance"), F.lit(99999.0)).asc()],
        "province": lambda: [F.coalesce(F.col("province"), F.lit("")).asc()],
        "rating-desc": lambda: [rating.desc_nulls_last(), F.when(rating.isNotNull(), reviews).desc_nulls_last()],
        "reviews-desc": lambda: [reviews.desc(), rating.desc_nulls_last()],
        "price-asc": lambda: [F.col("price").asc_nulls_last()],
        "price-desc": lambda: [F.col("price").desc_nulls_last()],
        "name": lambda: [fold(F.col("name")).asc(), F.col("name").asc()],
        "none": lambda: [],
    }[name]()


def sort_order(primary: str, secondary: str = "none", key: str = "slug") -> list[Column]:
    """Primary, secondary, name and finally the unique key."""
    second = [] if secondary == primary else sort_keys(secondary)
    return [*sort_keys(primary), *second, *sort_keys("name"), F.col(key).asc()]


def sort_catalog(df: DataFrame, primary: str, secondary: str = "none", key: str = "slug") -> DataFrame:
    return df.orderBy(*sort_order(primary, secondary, key))


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value) distinct non-empty values of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value is not null and value <> ''").distinct()


def city_centroids(df: DataFrame) -> DataFrame:
    located = df.where((F.coalesce(F.col("lat"), F.lit(0.0)) != 0) & (F.coalesce(F.col("lon"), F.lit(0.0)) != 0) & F.col("city").isNotNull())
    return located.groupBy("city").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def visible_extent(df: DataFrame, visible: Column) -> DataFrame:
    """Bounding box of visible located rows, and whether the default view applies (all visible)."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    shown = located & visible
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"),
                 *[f(F.when(shown, F.col(c))).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumn("default_view", F.col("shown") == F.col("total"))


def result_count(df: DataFrame, visible: Column, hide_visited: bool = False) -> DataFrame:
    hidden = F.count_if(F.coalesce(F.col("visited"), F.lit(False))) if hide_visited else F.lit(0).cast("bigint")
    out = df.agg(F.count_if(visible).alias("visible"), hidden.alias("hidden_visited"))
    return out.withColumn("not_found", F.col("visible") == 0)


def locale_routes(df: DataFrame, locales: Sequence[str] = vocab.LOCALES, key: str = "slug") -> DataFrame:
    """(lang, slug, target): each entity per locale, plus a lower-case alias where it differs."""
    names = F.array_distinct(F.array(F.col(key), F.lower(key)))
    return (df.where(active(F.col("status"))).select(F.col(key).alias("target"), F.explode(names).alias("route"))
            .withColumn("lang", F.explode(F.array(*[F.lit(x) for x in locales]))).select("lang", "route", "target"))


def select_by_keys(df: DataFrame, wanted: DataFrame, key: str = "slug") -> DataFrame:
    """wanted(key, pos): requested rows with their position; unknown keys drop out."""
    return df.join(wanted, key).select("pos", *df.columns)


def pending(df: DataFrame, store: DataFrame, key: str = "slug") -> DataFrame:
    return df.join(store.select(key).distinct(), key, "left_anti")


def missing_targets(df: DataFrame, field: str, missing: bool = True) -> DataFrame:
    present = F.coalesce(F.col(field).cast("string"), F.lit("")) != ""
    return df.where(~present if missing else present)


def limit_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
