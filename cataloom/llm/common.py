"""Helpers shared by the operators: bounded broadcasts, columns, components, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise

#: A side of at most so many narrow rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``limit``, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def to_python(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df`` as it is; its session now sends ``rows`` rows at once to Python, as texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A new schema with more columns of the named types behind those of ``schema``."""
    return T.StructType([*schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()]])


def crc_bucket(column: str, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def plain(model):
    """A model as a tuple, which executors can read without this package; other values as they are."""
    return tuple(vars(model).values()) if hasattr(model, "__dict__") else model


def rebuilt(value, kind):
    return kind(*value) if isinstance(value, tuple) else value


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """UTF-8 bytes of a string array, its offsets (null: empty), and the buffer behind them."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0], b""


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, at least one row."""
    lengths = batch.column(text).cast(pa.large_string())
    sizes = np.asarray(pa.compute.binary_length(lengths).fill_null(0), np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start)
    release()


def release() -> None:
    """Give memory that the last batch used back to the system; workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_parts(function, text: int):
    """A mapInArrow function that calls ``function`` on parts of bounded size."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield function(part)

    return run


def _least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the smallest node that each reaches: every group is hung on its smallest neighbour, until none is smaller."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    group = np.arange(len(nodes))
    while True:
        low = np.arange(len(nodes))
        np.minimum.at(low, group[u], group[v])
        np.minimum.at(low, group[v], group[u])
        while (low[low] != low).any():
            low = low[low]
        if (low[group] == group).all():
            return nodes, nodes[group]
        group = low[group]


def components(edges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``(node, component)`` for every node of undirected ``edges`` (u, v); component: the smallest node.

    ``edges`` are best a written table, as they are counted first. At most ``limit`` are settled at once by one task.
    More take alternating large-star and small-star steps.
    Each step keeps one edge per node and neighbour, finds minima by an aggregate combined before the shuffle, and
    is written to the shared folder, so that a lost executor costs one step.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64), *(np.stack([np.asarray(batch.column(i), np.int64) for i in (0, 1)]) for batch in batches)]
        found = _least_reached(*np.concatenate(held, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])

    edges = edges.select("u", "v").where("u <> v")
    if edges.count() <= limit:
        return to_python(edges.coalesce(1), 50_000).mapInArrow(run, "node long, component long")
    edges = materialise(_tidy(edges), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"))
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        older, edges = edges, materialise(_tidy(small.unionByName(first.select("u", F.col("m").alias("v")))), "edges")
        discard(older)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, once each."""
    return (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v").distinct())
