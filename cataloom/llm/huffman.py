"""Token-ID output: files of canonical length-limited Huffman codes with block checkpoints.

One file is one row of a table of blobs, so Spark's writers commit it and any store can hold it.
A file: magic, number of documents, of ids and of blocks; per document its doc_id, whether it
has one, and its number of ids; the bit offset of every ``BLOCK``-th id; the code bits. The code
is rebuilt from the lengths of all codes, which the table ``code`` beside the files holds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise, scratch_path
from .common import bounded, release, slices, to_python
from .tokens import Encoder, appended

END, LIMIT, BLOCK = 2, 16, 256
#: Bytes of text that one file should hold, and one task should encode, which remembers its pieces.
FILE_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Ids whose codes are placed at once.
CHUNK = 1 << 16
_MAGIC = b"HUF1"
_HEAD = "<4sqqq"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # Level by level: the weights of single ids merged with those of pairs of the level below.
    levels, packed = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packed])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(weight))
        merged = both[at]
        half = len(merged) // 2
        packed = merged[:2 * half].reshape(half, 2).sum(1)
    need, total = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for single in reversed(levels):
        taken = int(single[:need].sum())
        total[:taken] += 1
        need = 2 * (need - taken)
    lengths[order] = total
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    if len(order):
        step = np.left_shift(1, LIMIT - size)
        codes[order] = ((np.cumsum(step) - step) >> (LIMIT - size)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each ``LIMIT`` bits ahead: the id in the upper and the code's length in the lower bits."""
    table = np.zeros(1 << LIMIT, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    entries = (order.astype(np.uint32) << np.uint32(8)) | lengths[order].astype(np.uint32)
    filled = np.repeat(entries, np.left_shift(1, LIMIT - size))
    table[:len(filled)] = filled
    return table


def write_file(doc_ids: np.ndarray, has_id: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """The bytes of a file; codes are placed ``CHUNK`` ids at a time, each chunk at the bit where the last one ended."""
    size = lengths[ids]
    sums = np.add.reduceat(size, np.arange(0, len(ids), BLOCK), dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
    checks = (np.cumsum(sums) - sums).astype("<i8")
    total = int(sums.sum())
    bits = np.zeros((total + 31) // 32 + 2, np.uint32)
    base = 0
    for at in range(0, len(ids), CHUNK):
        part = size[at:at + CHUNK].astype(np.int64)
        ends = np.cumsum(part) + (base & 31)
        begin = ends - part
        word, first = begin >> 5, base >> 5
        value = codes[ids[at:at + CHUNK]].astype(np.uint64) << (64 - (begin & 31) - part).astype(np.uint64)
        n_words = int(ends[-1] >> 5) + 2
        # Codes share no bit, so sums below 2**32 are exact in doubles.
        held = (np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n_words)
                + np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words))[:n_words]
        bits[first:first + n_words] |= held.astype(np.uint32)
        base += int(ends[-1]) - (base & 31)
    return b"".join([struct.pack(_HEAD, _MAGIC, len(doc_ids), len(ids), len(checks)), doc_ids.astype("<i8").tobytes(), has_id.astype(np.uint8).tobytes(),
                     n_tokens.astype("<i8").tobytes(), checks.tobytes(), bits.astype(">u4").tobytes()])


def read_file(blob: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is one, ids of each document, and all ids; blocks are decoded side by side."""
    magic, docs, total, blocks = struct.unpack_from(_HEAD, blob)
    if magic != _MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(_HEAD)
    doc_ids = np.frombuffer(blob, "<i8", docs, at)
    has_id = np.frombuffer(blob, np.uint8, docs, at + 8 * docs).astype(bool)
    n_tokens = np.frombuffer(blob, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    position = np.frombuffer(blob, "<i8", blocks, at).copy()
    raw = np.frombuffer(blob, np.uint8, -1, at + 8 * blocks)
    # 32 bits from each byte on
    ahead = np.zeros(len(raw), np.uint32)
    for j in range(4):
        ahead[:len(raw) - j] |= raw[j:].astype(np.uint32) << np.uint32(24 - 8 * j)
    out = np.zeros((blocks, BLOCK), np.uint32)
    tail = total - (blocks - 1) * BLOCK if blocks else 0
    for step in range(BLOCK if blocks > 1 else tail):
        active = slice(None) if step < tail else slice(0, blocks - 1)
        p = position[active]
        entry = table[(ahead[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)]
        out[active, step] = entry >> np.uint32(8)
        position[active] = p + (entry & np.uint32(255))
    return doc_ids, has_id, n_tokens, out.ravel()[:total]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END, vocabulary: int = 1 << 16) -> None:
    """Write the ids of every text, ``end`` behind each, as files in ascending doc_id order.

    The files are rows (file, blob) of ``folder``/files, ``code`` holds the lengths of all codes.
    Texts are dealt by ranges of doc_id (null first, repeated ones in the order of their texts),
    encoded once and kept while all ids are counted. Null and empty texts are ``end`` alone. An
    empty table gives no file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, int((measured[0] + 8 * measured[1]) // RANGE_BYTES))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(ranges, key[0], key[1]).sortWithinPartitions(*key)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, file, part_no = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        seen = np.zeros(vocabulary, np.int64)
        kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
        for batch in batches:
            for part in slices(batch, 1, FILE_BYTES):
                ids, offsets = appended(*encoder.encode(part.column(1)), end)
                seen += np.bincount(ids, minlength=vocabulary)
                doc = np.asarray(part.column(0).fill_null(0), np.int64)
                has = ~np.asarray(part.column(0).is_null())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int32()), pa.array([part_no], pa.int32()), pa.array([doc.tobytes()], pa.binary()), pa.array([has.tobytes()], pa.binary()),
                     pa.array([np.diff(offsets).astype("<i8").tobytes()], pa.binary()), pa.array([ids.astype(kind).tobytes()], pa.binary()), pa.array([None], pa.binary())],
                    names=["range", "part", "docs", "has", "n", "ids", "counts"])
                part_no += 1
        used = np.flatnonzero(seen)
        pairs = np.stack([used, seen[used]], 1).astype("<i8")
        none = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([-1], pa.int32()), none, none, none, none, pa.array([pairs.tobytes()], pa.binary())],
                                         names=["range", "part", "docs", "has", "n", "ids", "counts"])

    kept = materialise(to_python(ordered, 2500).mapInArrow(encode, "range int, part int, docs binary, has binary, n binary, ids binary, counts binary"), "ids", "zstd")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for value in batch.column(0):
                pairs = np.frombuffer(value.as_buffer(), "<i8").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counted = kept.where("part = -1").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row an id
    counts = np.zeros(vocabulary, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = canonical(lengths)
        kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, dtype: np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_buffer(), dtype)  # noqa: E731, B023
                blob = write_file(get("docs", "<i8"), get("has", np.uint8), get("n", "<i8"), get("ids", kind).astype(np.int64), lengths, codes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([blob], pa.binary())], names=["range", "part", "blob"])
                del blob
                release()

    parts = to_python(kept.where("part >= 0").select("range", "part", "docs", "has", "n", "ids"), 1)
    (parts.mapInArrow(compress, "range int, part int, blob binary")
     .write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(f"{folder}/files"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents from the files; ``ids`` are little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before. Files are decoded one by one; only their
    numbers of ids are summed up across files.
    """
    lengths = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first()["lengths"]), np.uint8))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths.value)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, has, n, ids = read_file(batch.column(2)[i].as_py(), table)
                ends = np.cumsum(n)
                ids = ids.astype("<u4")
                blobs = [ids[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())]
                m = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0)[i].as_py(), m).astype(np.int32)), pa.array(np.repeat(batch.column(1)[i].as_py(), m).astype(np.int32)),
                     pa.array(doc, mask=~has), pa.array(ends - n), pa.array(n), pa.array(blobs, pa.binary())],
                    names=["range", "part", "doc_id", "inside", "n_tokens", "ids"])

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [struct.unpack(_HEAD, x)[2] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64())], names=["range", "part", "total"])

    files = to_python(spark.read.schema("range int, part int, blob binary").parquet(f"{folder}/files"), 4)
    sizes = files.select("range", "part", F.substring("blob", 1, struct.calcsize(_HEAD)).alias("head")).mapInArrow(heads, "range int, part int, total long")
    # Sums by level (1,024 ranges, range, part), so that no task sorts all files.
    known = materialise(sizes.withColumn("top", F.shiftright("range", 10)), "sizes")

    def earlier(level: DataFrame, within: list[str], order: str, out: str) -> DataFrame:
        window = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return level.withColumn(out, F.coalesce(F.sum("total").over(window), F.lit(0))).drop("total")

    tops = earlier(known.groupBy("top").agg(F.sum("total").alias("total")), [], "top", "a")
    ranges = earlier(known.groupBy("top", "range").agg(F.sum("total").alias("total")), ["top"], "range", "b")
    starts = earlier(known, ["top", "range"], "part", "c").join(ranges, ["top", "range"]).join(tops, "top")
    starts = bounded(starts.select("range", "part", (F.col("a") + F.col("b") + F.col("c")).alias("base")), known.count())
    return (files.mapInArrow(run, "range int, part int, doc_id long, inside long, n_tokens long, ids binary")
            .join(starts, ["range", "part"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids"))


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """The documents as read back from files that were just written in the shared folder."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_tokens(docs, tokenizer, folder, end)
    return read_tokens(spark, folder)
