"""Bounded samples of labelled rows, and the words of text batches, for the learned operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, crc_bucket
from .setjoin import _LOWER, _SPACE, hash_slices

#: A fit uses about this many labelled rows of each class, and of those only texts of at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 32_768


def sampled(rows: DataFrame, by: str, most: int | dict = SAMPLE_ROWS) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (or a number for each), chosen by a hash of doc_id."""
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, (most[value] if isinstance(most, dict) else most) / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)


def labelled(docs: DataFrame, labels: DataFrame, column: str, parts: int, held_out: int,
             most: int | dict = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of learnable rows; rows of bucket ``held_out`` are not read.

    Null labels and null doc_ids teach nothing; of several labels of one doc_id the largest holds.
    """
    known = (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
             .where(crc_bucket("doc_id", parts) != held_out))
    chosen = F.broadcast(sampled(known, "label", most))  # about 2 * most rows by construction
    rows = (docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)
            & (crc_bucket("doc_id", parts) != held_out)).join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label").toArrow())
    rows = rows.sort_by("doc_id")
    return list(zip(rows["text"].to_pylist(), map(int, rows["label"].to_pylist())))


def held_out(parts: int, bucket: int) -> Column:
    return F.coalesce(crc_bucket("doc_id", parts) == bucket, F.lit(False)).alias("held_out")


#: Letters, digits and all bytes of other alphabets; the rest separates words here.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_codes(texts: pa.Array):
    """Distinct lower-cased words of a batch, each word's code, and the offsets of the texts.

    Returns (bytes, starts, ends) of one place for each distinct word, their hashes, codes, offsets.
    """
    data, offsets, _ = byte_view(texts)
    data = _LOWER[data]
    mask = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~mask[:-1], ~mask[1:]
    first = np.flatnonzero(mask & (before | edge[:-1]))
    last = np.flatnonzero(mask & (after | edge[1:])) + 1
    hashed = hash_slices(data, first, last)
    unique, place, codes = np.unique(hashed, return_index=True, return_inverse=True)
    return data, first[place], last[place], unique, codes, np.searchsorted(first, offsets)


def coded_texts(texts: list[str], most: int = 1 << 20):
    """As `word_codes` for many texts, about ``most`` bytes at a time; only the bytes of distinct words are kept."""
    held, lengths, hashes, codes, counts, base = [], [], [], [], [np.zeros(1, np.int64)], 0
    parts, size = [[]], 0
    for text in texts:
        if size >= most:
            parts.append([])
            size = 0
        parts[-1].append(text)
        size += len(text)
    for part in parts:
        data, first, last, unique, local, offsets = word_codes(pa.array(part, pa.string()))
        length = last - first
        ends = np.cumsum(length)
        held.append(data[np.repeat(first - ends + length, length) + np.arange(int(length.sum()))])
        lengths.append(length)
        hashes.append(unique)
        codes.append((local + base).astype(np.int32))
        counts.append(np.diff(offsets))
        base += len(unique)
    unique, place, merged = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    merged = merged.astype(np.int32)
    length = np.concatenate(lengths)
    last = np.cumsum(length)
    codes = np.concatenate([merged[c] for c in codes])
    return np.concatenate(held), (last - length)[place], last[place], unique, codes, np.cumsum(np.concatenate(counts))


__all__ = ["coded_texts", "SAMPLE_BYTES", "SAMPLE_ROWS", "_SPACE", "held_out", "labelled", "sampled", "word_codes"]
