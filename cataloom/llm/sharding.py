"""Sharding by histogram sort: splitters from exact byte counts below probes, then one exchange."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from .common import bounded, extended

#: Keys are pairs of signed 64-bit integers, here one number from 0 to 2**128.
_BIAS, _SPAN = 1 << 63, 1 << 64
#: Probes of each splitter and round; rows of one sorted part.
PROBES, PART_ROWS = 32, 500_000


def _pair(key: int) -> tuple[int, int]:
    return key // _SPAN - _BIAS, key % _SPAN - _BIAS


def _below(rows: DataFrame, probes: list[int], parts: int) -> tuple[list[int], list[int]]:
    """Bytes and rows below each of the sorted ``probes``, exactly, in one pass over (k, t, size)."""
    high = np.array([_pair(p)[0] for p in probes], np.int64)
    low = np.array([_pair(p)[1] for p in probes], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, count = np.zeros(len(high) + 1, np.int64), np.zeros(len(high) + 1, np.int64)
        for batch in batches:
            k, t, n = (np.asarray(batch.column(i), np.int64) for i in range(3))
            at, end = np.searchsorted(high, k, "left"), np.searchsorted(high, k, "right")
            # rows whose k is a probe's: compare t with the probes of that k
            for i in np.unique(at[at < end]):
                mine = np.flatnonzero((at == i) & (at < end))
                at[mine] = i + np.searchsorted(low[i:end[mine[0]]], t[mine], "right")
            # a row in bucket i is below probe i and all later ones
            np.add.at(size, at, n)
            count += np.bincount(at, minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(size))), pa.array(size), pa.array(count)], names=["i", "size", "n"])

    got = rows.select("k", "t", "size").mapInArrow(run, "i long, size long, n long").groupBy("i").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, count = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:
        size[r["i"]], count[r["i"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist()


def splitters(rows: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """For each target the smallest key with at least so many bytes below it, up to ``tolerance`` bytes.

    Each round counts exactly below evenly spaced probes of every interval still open, and keeps the
    part between the probes that enclose the target.
    """
    ends = rows.agg(F.min(F.struct("k", "t")).alias("a"), F.max(F.struct("k", "t")).alias("b")).first()
    number = lambda x: (x["k"] + _BIAS) * _SPAN + x["t"] + _BIAS
    spans = [(number(ends["a"]), number(ends["b"]) + 1) for _ in targets]  # below the first key 0 bytes, below the last one's successor all
    done: list[int | None] = [None] * len(targets)
    while any(d is None for d in done):
        probes = sorted({a + (b - a) * j // (PROBES + 1) for (a, b), d in zip(spans, done) if d is None for j in range(1, PROBES + 1)})
        size, _ = _below(rows, probes, len(targets))
        known = dict(zip(probes, size))
        for i, (a, b) in enumerate(spans):
            if done[i] is not None:
                continue
            inside = [p for p in probes if a < p < b]
            enough = [p for p in inside if known[p] >= targets[i]]
            b = min([b, *enough])
            a = max([a, *[p for p in inside if known[p] < targets[i]]])
            spans[i] = (a, b)
            if b - a <= 1 or (b in known and known[b] - targets[i] <= tolerance):
                done[i] = b
    return done


def shard_rows(docs: DataFrame, shards: int = 8, tolerance: float = 0.0, part_rows: int = PART_ROWS) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``: shards of near equal bytes in the order of doc_id.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows are ordered by
    (doc_id, null first; then a hash of the text); a row belongs to shard ``floor(shards * bytes before it /
    all bytes)``, exactly if ``tolerance`` is 0. Rows alike in doc_id and text stay together; so a shard
    is within one such group of its share. Slots count the rows of a shard from 0 in that
    order. Further splitters cut shards into parts of about ``part_rows`` rows, so that one
    exchange serves both and no task holds a whole shard. No rows give no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    # A hash over 64 bits whose place for null rows is before all others of the least doc_id.
    tie = F.xxhash64("text")
    narrow = materialise(docs.select(key.alias("k"), tie.alias("t"), size.alias("size")), "keys")
    total, rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    empty = docs.select(*names).withColumn("size", size).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    if not rows:
        return empty
    inner = max(1, -(-rows // (shards * part_rows)))
    targets = [total * i / (shards * inner) for i in range(1, shards * inner)]
    cuts = splitters(narrow, targets, tolerance)
    high = np.array([_pair(c)[0] for c in cuts], np.int64)
    low = np.array([_pair(c)[1] for c in cuts], np.int64)
    shared = spark.sparkContext.broadcast((high, low))  # one pair for every ``part_rows`` rows

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = shared.value
        for batch in batches:
            k, t = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            at, end = np.searchsorted(high, k, "left"), np.searchsorted(high, k, "right")
            for i in np.unique(at[at < end]):
                mine = np.flatnonzero((at == i) & (at < end))
                at[mine] = i + np.searchsorted(low[i:end[mine[0]]], t[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "_part"])

    # The row's own columns travel in one struct, whatever their names.
    keyed = docs.select(key.alias("_k"), tie.alias("_t"), F.struct(*names).alias("_row"), size.alias("size"))
    parts = keyed.mapInArrow(place, extended(keyed.schema, _part="int"))
    order = W.partitionBy("_part").orderBy("_k", "_t")
    ranked = parts.repartition(shards * inner, "_part").withColumn("_rank", F.row_number().over(order) - 1)
    # rows of the parts before, in the same shard; one row a part
    counts = narrow.mapInArrow(place, extended(narrow.schema, _part="int")).groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    shard = F.floor(F.col("_part") / inner).cast("int")
    counts = counts.withColumn("shard", shard)
    before = F.sum("n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("_part", "shard", F.coalesce(before, F.lit(0)).alias("_base"))
    return (ranked.join(bounded(bases, shards * inner), "_part")
            .select(*[F.col("_row")[c].alias(c) for c in names], F.col("size"), "shard", (F.col("_rank") + F.col("_base")).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the rows of ``shard_rows`` to one folder per shard."""
    shard_rows(docs, shards).write.partitionBy("shard").parquet(path)
