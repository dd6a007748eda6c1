"""Snapshot ingest, expiring lists and monthly counters as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocab
from ..operators.quality import DatasetRules, dataset_verdict
from ..operators.scale import one_per_key
from ..operators.snapshot import soft_delete_merge
from ..session import ROCKSDB, STATE_STORE, materialise
from ..sources.publish import publish_if_changed, published_from, quarantine, read_published


def announce(snapshot: DataFrame, path: str, inbox: str) -> None:
    """Write a snapshot folder, then its arrival notice: one small row naming the folder."""
    snapshot.write.parquet(path)
    snapshot.sparkSession.createDataFrame([(path,)], "path string").write.mode("append").json(inbox)


def read_arrivals(spark: SparkSession, inbox: str) -> DataFrame:
    """Stream of arrival notices, one notice file per micro-batch."""
    return spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).json(inbox)


def ingest_snapshots(arrivals: DataFrame, root: str, checkpoint: str, rules: DatasetRules = DatasetRules(),
                     errors: Column | None = None, key: str = "slug") -> StreamingQuery:
    """Merge each announced snapshot into the published table; one failing the gates is skipped.

    Only the notices stream through the driver; the snapshot itself is read from its folder with
    full parallelism. The manifest names stream and batch of each version, so a batch repeated
    after a failure merges nothing twice, whatever was published before under other names. A refused
    snapshot leaves its notice and its failed rules in the quarantine table, in the same batch.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        for i, row in enumerate(batch.orderBy("path").toLocalIterator()):
            origin = f"{stream}/{batch_id}/{i}"
            if published_from(spark, root, origin):
                continue
            fresh, published = spark.read.parquet(row.path), read_published(spark, root)
            merged = fresh if published is None else materialise(soft_delete_merge(fresh, published, key), "merged")
            verdict = materialise(dataset_verdict(merged, published, rules, errors, key), "verdict")
            if verdict.first().is_valid:
                publish_if_changed(merged, root, origin.replace("/", "-").replace(":", "-"), origin)
            else:
                quarantine(verdict, root, stream, batch_id, i, row.path)

    return (arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class _NewestList(StatefulProcessor):
    """The newest list of a code, and a timer at the end of its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at bigint, items string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.newest.get()) if self.newest.exists() else None
        best = held
        for part in rows:
            top = part.loc[part["at"].idxmax()]
            if best is None or int(top["at"]) >= best[0]:
                best = (int(top["at"]), str(top["items"]))
        if held is not None and best[0] != held[0]:
            self.handle.deleteTimer(held[0] // 1000 + self.ttl_ms)
        if held is None or best[0] != held[0]:
            self.handle.registerTimer(best[0] // 1000 + self.ttl_ms)
        self.newest.update(best)
        yield _change(key[0], *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            at, items = self.newest.get()
            self.newest.clear()
            yield _change(key[0], at, items, True)

    def close(self) -> None:
        pass


def _change(code: str, at: int, items: str, deleted: bool) -> pd.DataFrame:
    return pd.DataFrame({"code": [code], "at": [at], "items": [items], "deleted": [deleted]})


def latest_lists(pushes: DataFrame, ttl_days: int = vocab.LIST_TTL_DAYS, max_items: int = vocab.LIST_MAX_ITEMS, late: str = "1 day") -> DataFrame:
    """pushes(code, updated_at, items array<string>) -> changes (code, updated_at, items, deleted) of the lists.

    A push replaces the list of its code unless an older one comes late; a list not pushed for
    ``ttl_days`` is given once more as deleted and leaves the state. Time is the time of the pushes: any row,
    also one with a code that is none, moves it on, ``late`` behind the newest one. So the stream ends
    by itself under an available-now trigger. State is kept in RocksDB, which the session has to name.
    """
    if "RocksDB" not in pushes.sparkSession.conf.get(STATE_STORE, ""):
        raise RuntimeError(f"set {STATE_STORE} to {ROCKSDB}")
    timed = pushes.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", late)
    # A condition on time stays above the watermark, so that rows without a code move the time on.
    timely = F.when(F.col("updated_at").isNotNull(), F.length("code") == 6)
    cut = timed.withColumn("code", F.regexp_replace("code", r"\D", "")).where(timely).select(
        "code", "updated_at", F.unix_micros("updated_at").alias("at"), F.to_json(F.slice("items", 1, max_items)).alias("items"))
    kept = cut.groupBy("code").transformWithStateInPandas(
        _NewestList(ttl_days * 86_400_000), "code string, at bigint, items string, deleted boolean", "update", "eventTime")
    return kept.select("code", F.timestamp_micros("at").alias("updated_at"), "items", "deleted")


def store_lists(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the changes of each batch under its own number, so that a batch run again replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_lists(spark: SparkSession, root: str) -> DataFrame:
    """(code, updated_at, items, deleted): the last change of each code."""
    return one_per_key(spark.read.parquet(root), ["code"], F.col("batch")).drop("batch")


def monthly_counter(requests: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Successful requests per calendar month; works on batches and, with a watermark, on streams."""
    rows = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if requests.isStreaming else rows
    month = F.date_trunc("month", F.col(ts)).cast("date").alias("month")
    return rows.where("ok").groupBy(month).agg(F.count(F.lit(1)).alias("used"))


def daily_usage(requests: DataFrame, ts: str = "ts", key: str = "request_id", late: str = "1 day") -> DataFrame:
    """Stream of requests(request_id, ts, ok) -> (day, used), given again whenever a day's number grows.

    A request told twice within ``late`` counts once. Both states follow the time of the requests: an
    id is forgotten, and a day closed, once the newest request is ``late`` beyond it.
    """
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where("ok")
    once = timed.dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("used")).select(F.col("window.start").cast("date").alias("day"), "used")


def store_usage(usage: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the numbers of each batch under its own number, so that a batch run again replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return usage.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_months(spark: SparkSession, root: str) -> DataFrame:
    """(month, used), added up from the last number of each day."""
    days = one_per_key(spark.read.parquet(root), ["day"], F.col("batch"))
    return days.groupBy(F.date_trunc("month", "day").cast("date").alias("month")).agg(F.sum("used").alias("used"))
