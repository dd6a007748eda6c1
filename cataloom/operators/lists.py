"""User lists: cleaning, ranking, merging, exchange formats and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vocab
from ..session import materialise
from .scale import one_per_key, rank_rows


def dedupe_keep_first(items: DataFrame, owner: str = "owner", item: str = "item", pos: str = "pos") -> DataFrame:
    """Earliest entry per owner and item; blank items drop out."""
    return one_per_key(items.where(F.coalesce(F.col(item).cast("string"), F.lit("")) != ""), [owner, item], F.col(pos), newest=False)


def rank_items(items: DataFrame, owner: str = "owner", pos: str = "pos") -> DataFrame:
    """1-based rank in list order; a giant list is sorted by many tasks."""
    return rank_rows(items, [F.col(pos)], [owner], "rank")


def export_rows(items: DataFrame, catalog: DataFrame, owner: str = "owner", item: str = "item") -> DataFrame:
    """Spreadsheet rows of ranked items, names falling back to the key."""
    known = catalog.select(F.col("slug").alias(item), "name", "city", "province", "website")
    joined = items.join(known, item, "left")
    return joined.select(owner, F.col("rank").alias("Rank"), F.col(item).alias("Slug"), F.coalesce("name", item).alias("Name"),
                         F.coalesce("city", F.lit("")).alias("City"), F.coalesce("province", F.lit("")).alias("Province"),
                         F.when(F.col("visited"), "Yes").otherwise("No").alias("Visited"), F.coalesce("note", F.lit("")).alias("Note"),
                         F.coalesce("website", F.lit("")).alias("Website"))


def export_documents(items: DataFrame, catalog: DataFrame, exported_at: str, owner: str = "owner", item: str = "item",
                     chunk: int | None = None) -> DataFrame:
    """(owner, part, document): one versioned JSON document per list.

    With ``chunk`` a list is written as parts of at most so many items; each document then names
    its part (from 0) and the number of parts, which ``parse_documents`` reads back.
    """
    named = items.join(catalog.select(F.col("slug").alias(item), "name"), item, "left")
    entry = F.struct(F.col("rank").alias("rank"), F.col(item).alias("slug"), F.col("visited").alias("visited"),
                     F.coalesce("note", F.lit("")).alias("note"), F.coalesce("name", item).alias("name"))
    part = F.floor((F.col("rank") - 1) / chunk) if chunk else F.lit(0).cast("bigint")
    parts = named.groupBy(owner, part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("_items"))
    if chunk:
        total = named.groupBy(owner).agg(F.ceil(F.max("rank") / chunk).alias("parts"))
        parts = parts.join(total, owner)
    head = [F.lit("1.0").alias("version"), F.lit(exported_at).alias("exported_at"), *([F.col("part"), F.col("parts")] if chunk else [])]
    body = F.transform("_items", lambda x: F.struct(x["slug"].alias("slug"), x["visited"].alias("visited"), x["note"].alias("note"), x["name"].alias("name")))
    return parts.select(owner, "part", F.to_json(F.struct(*head, body.alias("items"))).alias("document"))


def parse_documents(docs: DataFrame, column: str) -> DataFrame:
    """Items of list documents: a bare array or {items: [...]}, each item a key or an object.

    ``part`` is 0 unless the document names its part; (part, pos) is the order of a list.
    """
    v = F.try_parse_json(F.col(column))
    whole = F.try_variant_get(v, "$", "array<variant>")
    inner = F.try_variant_get(v, "$.items", "array<variant>")
    rest = [c for c in docs.columns if c != column]
    part = F.coalesce(F.try_variant_get(v, "$.part", "int"), F.lit(0))
    rest = [c for c in rest if c != "part"]
    rows = docs.select(*rest, part.alias("part"), F.posexplode(F.coalesce(whole, inner)).alias("pos", "_it"))
    is_object = F.try_variant_get("_it", "$", "map<string,variant>").isNotNull()
    slug = F.when(is_object, F.try_variant_get("_it", "$.slug", "string")).otherwise(F.try_variant_get("_it", "$", "string"))
    return rows.select(*rest, "part", "pos", slug.alias("slug"), F.coalesce(F.try_variant_get("_it", "$.visited", "boolean"), F.lit(False)).alias("visited"),
                       F.coalesce(F.try_variant_get("_it", "$.note", "string"), F.lit("")).alias("note")).where("slug is not null and slug <> ''")


def merge_shared(shared: DataFrame, own: DataFrame) -> DataFrame:
    """Shared order (owner, item, pos) with the owner's saved state where there is one."""
    state = own.select("owner", "item", "visited", "note")
    joined = shared.select("owner", "item", "pos").join(state, ["owner", "item"], "left")
    return joined.select("owner", "item", "pos", F.coalesce("visited", F.lit(False)).alias("visited"), F.coalesce("note", F.lit("")).alias("note"))


def append_unseen(own: DataFrame, pulled: DataFrame) -> DataFrame:
    """Own list, then the pulled items it lacks, in their order; ``block`` tells the two apart."""
    fresh = pulled.join(own.select("owner", "item").distinct(), ["owner", "item"], "left_anti")
    return own.withColumn("block", F.lit(0)).unionByName(fresh.withColumn("block", F.lit(1)))


def list_stats(items: DataFrame, owner: str = "owner") -> DataFrame:
    return items.groupBy(owner).agg(F.count(F.lit(1)).alias("items"), F.count_if("visited").alias("visited"))


def latest_per_code(pushes: DataFrame, as_of: Column, ttl_days: int = vocab.LIST_TTL_DAYS, max_items: int = vocab.LIST_MAX_ITEMS) -> DataFrame:
    """pushes(code, updated_at, items) -> the newest unexpired list per six-digit code."""
    digits = F.regexp_replace("code", r"\D", "")
    valid = pushes.withColumn("code", digits).where(F.length("code") == 6)
    newest = one_per_key(valid, ["code"], F.col("updated_at"))
    alive = newest.where(F.col("updated_at") > as_of - F.expr(f"interval {ttl_days} days"))
    return alive.withColumn("items", F.slice("items", 1, max_items))


def assign_batches(df: DataFrame, key: str, size: int = vocab.BATCH_SIZE) -> DataFrame:
    """Consecutive batches in key order, without sorting the table in one task."""
    ranked = rank_rows(df, [F.col(key)], (), "_rank")
    return ranked.withColumn("batch", F.ceil(F.col("_rank") / size)).drop("_rank")


#: Most requests of a period that are ranked in one task, and probes of a round before that.
RANKED_AT_ONCE = 100_000
PROBES = 512


def _cut_spans(good: DataFrame, limit: int, bound: int) -> DataFrame:
    """Per period the span of time (lo, hi) of its ``limit``-th success, how many it holds and which of them (``need``).

    Successes are counted below evenly spaced times, and the span that holds the wanted one is split again,
    until it holds at most ``bound`` or is one moment. Only counts are shuffled, combined before.
    """
    spans = materialise(good.groupBy("period").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") >= limit).withColumn("need", F.lit(limit).cast("long")), "spans")
    wide = (F.col("n") > bound) & (F.col("lo") < F.col("hi"))
    while not spans.where(wide).isEmpty():
        probe = F.floor((F.col("_at") - F.col("lo")) / F.ceil((F.col("hi") - F.col("lo") + 1) / PROBES))
        counted = (good.join(spans.where(wide), "period").where("_at between lo and hi").groupBy("period", "need", probe.alias("_probe"))
                   .agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count(F.lit(1)).alias("n")))
        upto = counted.withColumn("_upto", F.sum("n").over(W.partitionBy("period").orderBy("_probe")))
        within = upto.where("_upto >= need and _upto - n < need").select("period", "lo", "hi", "n", (F.col("need") - F.col("_upto") + F.col("n")).alias("need"))
        spans = materialise(spans.where(~wide).unionByName(within), "spans")
    return spans


def quota_admit(requests: DataFrame, period: Column, limit: int = vocab.MONTHLY_QUOTA, ts: str = "ts", key: str = "request_id", bound: int = RANKED_AT_ONCE) -> DataFrame:
    """First ``limit`` successful requests per period are admitted, later ones deferred; ties in time by key.

    Only the limit-th success of each period is looked up, in the short span that `_cut_spans` leaves; every
    request is then compared with that cut-off, so neither a busy period nor a large limit meets in one task.
    """
    rows = requests.withColumn("period", period)
    good = rows.where("ok").select("period", ts, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    spans = _cut_spans(good, limit, bound)
    near = good.join(spans, "period").where("_at between lo and hi")
    few = near.where(F.col("n") <= bound).withColumn("rank", F.row_number().over(W.partitionBy("period").orderBy(ts, key)))
    cutoff = few.where("rank = need").select("period", F.struct(ts, key).alias("_cut"))
    if not spans.where(F.col("n") > bound).isEmpty():
        # A moment with more requests than that is ranked by a distributed sort.
        many = rank_rows(near.where(F.col("n") > bound), [F.col(ts), F.col(key)], ["period"])
        cutoff = cutoff.unionByName(many.where("rank = need").select("period", F.struct(ts, key).alias("_cut")))
    joined = rows.join(cutoff, "period", "left")
    within = F.col("_cut").isNull() | (F.struct(ts, key) <= F.col("_cut"))
    return joined.withColumn("admitted", within).drop("_cut")
