"""Set similarity join of texts or lines: hashed word shingles, rare first, prefix filters.

The steps, each a Spark job over the whole table:

1. ``describe`` gives one row per unit (a text, or a line of a text) with the size and the
   fingerprint of its shingle set, and counts all shingles in a table of 2**22 counters. The
   counters bound each shingle's frequency from above; they order shingles by rarity.
2. ``postings`` sends the prefix of every distinct set, dealt in blocks by shingle, and keeps
   the shingles that at least two sets have in their prefixes.
3. ``candidates`` keeps the postings that have a partner in their list: ``passing`` states the length and
   positional filters for two sets that share a shingle, ``near`` the filter on the marks of both sets.
4. ``long_marks_of`` reads the sets that are left once and marks them with twice as many bits as they have
   shingles; ``narrowed`` drops the pairs whose long marks are too far apart for a link.
5. ``sets_of`` reads the sets of the pairs that are left, and ``verify`` counts the shared shingles, once per pair.

Tables that no later step reads are deleted, and shuffle files go with the step that wrote them.

A shingle is a 64-bit hash of its words and a set a 64-bit sum of its mixed shingles: two
different sets among 10**10 share a fingerprint with a chance of about one in a few.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, materialise, tidy_shuffles
from .common import BROADCAST_ROWS, bounded, byte_view, release, slices, to_python

BITS, SLICES = 22, 64
#: A shingle counted more often than this is dealt by set instead of by shingle.
HOT = 1 << 17
#: Postings that one block of the reduce side should hold.
BUCKET_ROWS = 200_000
#: Postings that a task of the map side holds before it sends them, so that a block is not a few rows.
HELD_ROWS = 500_000
#: Bits of the long marks of a set, at least and at most.
LONG_BITS = 1 << 9, 1 << 17
#: Long marks of all sets that may be broadcast.
MARK_BYTES = 8 << 20
#: Longer lists keep all their postings, so that the search for partners costs no more than this a posting.
LONG = 256
_NO_DOC = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Odd factors of the words of a shingle, by place.
_FACTORS = [_M1, *(np.uint64(pow(int(_M1), j, 1 << 64)) for j in range(2, 17))]


@dataclass(frozen=True)
class Rule:
    """Link when ``den`` * intersection >= ``num`` * union; shingles of ``width`` words of texts or lines."""

    width: int = 5
    num: int = 75
    den: int = 100
    lines: bool = False

    @property
    def marks(self) -> int:
        """Words of 64 bits that mark a set; texts have more shingles than lines."""
        return 1 if self.lines else 8

    @property
    def carried(self) -> int:
        """Words of the marks that travel with each posting; those of texts are too long for that."""
        return self.marks if self.lines else 0

    def probe(self, n):
        """Length of the prefix that meets any set at least as small."""
        return n - -(-self.num * n // self.den) + 1

    def index(self, n):
        """Length of the prefix that meets any set at least as large."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def overlap(self, total):
        """Shared shingles that two sets need, whose sizes sum to ``total``."""
        return -(-self.num * total // (self.num + self.den))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes of all ranges at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", buffer=padded.data, strides=(1,))
    length = (end - start).astype(np.uint64)
    out = length * _M3
    long = np.flatnonzero(length > 256)
    active, off = np.flatnonzero(length <= 256), 0
    while len(active):
        left = length[active] - np.uint64(off)
        keep = np.minimum(left, np.uint64(8)) * np.uint64(8)
        mask = np.where(keep == 64, ~np.uint64(0), (np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1))
        out[active] = mix(out[active] ^ (words[start[active] + off] & mask))
        active, off = active[left > 8], off + 8
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes())
    return out


def unit_sets(texts: pa.Array, rule: Rule):
    """Shingle sets of all units of ``texts``.

    Returns the row and line of each unit, its number of words, its set's size and fingerprint,
    and all shingles, sorted inside each unit, with the offsets of the units.
    """
    data, offsets, _ = byte_view(texts)
    data = _LOWER[data]
    starts = offsets[:-1]
    row = np.arange(len(starts))
    line = np.zeros(len(starts), np.int64)
    if rule.lines:
        breaks = np.flatnonzero(data == 10) + 1
        at = np.concatenate([starts, breaks])
        order = np.argsort(at, kind="stable")
        owner = np.concatenate([row, np.searchsorted(offsets, breaks - 1, "right") - 1])
        starts, row = at[order], owner[order]
        # a break at the very end of a text opens its last, empty line; keep it beside the next text's start
        fix = np.lexsort((starts, row))
        starts, row = starts[fix], row[fix]
        line = np.arange(len(row)) - np.searchsorted(row, row)
    ends = np.append(starts[1:], len(data))
    mask = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    before = np.ones(len(data), bool)
    before[1:] = ~mask[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~mask[1:]
    first = np.flatnonzero(mask & (before | edge[:-1]))
    last = np.flatnonzero(mask & (after | edge[1:])) + 1
    hashed = hash_slices(data, first, last)
    begin = np.searchsorted(first, starts)
    words = np.searchsorted(first, ends) - begin
    k = rule.width
    count = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    unit = np.repeat(np.arange(len(words)), count)
    offset = np.concatenate([[0], np.cumsum(count)])
    at = begin[unit] + (np.arange(len(unit)) - offset[unit])
    rolled = np.full(len(hashed), k, np.uint64) * _M3
    for j, factor in enumerate(_FACTORS[:k]):
        rolled[:len(rolled) - j] += hashed[j:] * factor
    acc = rolled[at]
    few = np.flatnonzero((words < k) & (words > 0))
    if len(few):
        acc[offset[few]] = words[few].astype(np.uint64) * _M3
        for j, factor in enumerate(_FACTORS[:k]):
            some = few[words[few] > j]
            acc[offset[some]] += hashed[begin[some] + j] * factor
    acc = mix(acc)
    for a, b in zip(offset[:-1][count > 1].tolist(), offset[1:][count > 1].tolist()):
        acc[a:b].sort()
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (unit[1:] != unit[:-1])
    acc, unit = acc[keep], unit[keep]
    size = np.bincount(unit, minlength=len(words))
    offset = np.concatenate([[0], np.cumsum(size)])
    print_ = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(size > 0)
    if len(some):
        print_[some] = np.add.reduceat(mix(acc * _M3 + _M1), offset[:-1][some])
    print_ = mix(print_ ^ (size.astype(np.uint64) * _M2)).view(np.int64)
    return row, line, words, size, print_, acc, offset


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(_NO_DOC), np.int64)


def set_marks(tokens: np.ndarray, offset: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words for each set: a bit tells whether an odd number of its shingles fall on it.

    Two sets differ in at least as many shingles as their marks differ in bits.
    """
    units, bits = len(offset) - 1, 64 * words
    out = np.zeros((units, words), np.int64)
    step = (1 << 20) // bits
    for a in range(0, units, step):
        b = min(a + step, units)
        held = tokens[offset[a]:offset[b]]
        unit = np.repeat(np.arange(b - a), np.diff(offset[a:b + 1]))
        odd = np.bincount(unit * bits + (mix(held ^ _M2) % np.uint64(bits)).astype(np.int64), minlength=(b - a) * bits) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(b - a, words)
    return out


def describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """Unit rows (doc, print, line, words, n, fp, bits) and, with ``slice`` set, one task's shingle counters.

    ``print`` is a 64-bit hash of the whole text, which tells rows of one doc_id apart.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for part in slices(batch, 1):
                row, line, words, size, fp, tokens, offset = unit_sets(part.column(1), rule)
                bits = set_marks(tokens, offset, rule.marks)
                np.add.at(counts, (tokens >> np.uint64(64 - BITS)).astype(np.int64), np.int32(1))
                none = pa.nulls(len(row), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(line.astype(np.int32)), pa.array(words), pa.array(size), pa.array(fp), none, pa.nulls(len(row), pa.binary()),
                     part.column(2).take(pa.array(row)), pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * rule.marks), pa.array(bits.reshape(-1)))],
                    names=["doc", "line", "words", "n", "fp", "slice", "counts", "print", "bits"])
        parts = [x.astype("u1" if x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4") for x in counts.reshape(SLICES, -1)]
        none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        for i in [i for i, x in enumerate(parts) if x.any()]:
            yield pa.RecordBatch.from_arrays([*none, pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))],
                                             names=["doc", "line", "words", "n", "fp", "slice", "counts", "print", "bits"])
        release()

    schema = "doc long, line int, words long, n long, fp long, slice int, counts binary, print long, bits array<long>"
    return materialise(to_python(docs.select("doc_id", "text", F.xxhash64("text").alias("print"))).mapInArrow(run, schema), "sets")


def rarity(described: DataFrame) -> bytes:
    """One byte for each counter, higher for more frequent shingles; 4 MB at any size of the corpus."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = counts.as_buffer()
                got = np.frombuffer(got, f"<u{len(got) * SLICES >> BITS}").astype(np.int64)
                sums[i] = sums[i] + got if i in sums else got
        classes = {i: np.minimum(255, np.floor(4 * np.log2(x + 1))).astype(np.uint8).tobytes() for i, x in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(classes), pa.int32()), pa.array(list(classes.values()), pa.binary())], names=["slice", "classes"])

    rows = (described.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
            .mapInArrow(run, "slice int, classes binary").collect())
    found = {r["slice"]: bytes(r["classes"]) for r in rows}
    return b"".join(found.get(i, bytes((1 << BITS) // SLICES)) for i in range(SLICES))


def partnered(token: np.ndarray, fp: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, size: np.ndarray, rule: Rule) -> np.ndarray:
    """Which postings may link with another one of their list by its size, place and marks.

    ``size`` is the length of the whole list. Postings of lists of more than ``LONG``, and of lists
    that are not here as a whole, are all kept.
    """
    order = np.lexsort((fp, n, token))
    token, n, pos, bits, size = token[order], n[order], pos[order], bits[order], size[order]
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
    length = np.diff(edges)
    end = np.repeat(edges[1:], length)
    keep = (size > LONG) | (size != np.repeat(length, length))
    a, step = np.flatnonzero(~keep), 1
    while len(a):
        a = a[a + step < end[a]]
        a = a[n[a] * rule.den >= n[a + step] * rule.num]
        b, need = a + step, rule.overlap(n[a] + n[a + step])
        ok = (pos[a] < rule.index(n[a])) & (np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need)
        at, other, most = a[ok], b[ok], (n[a] + n[b] - 2 * need)[ok]
        ok = np.bitwise_count(bits[at] ^ bits[other]).sum(1, dtype=np.int64) <= most
        keep[at[ok]] = keep[other[ok]] = True
        step += 1
    out = np.empty(len(keep), bool)
    out[order] = keep
    return out


def postings(docs: DataFrame, described: DataFrame, rule: Rule) -> DataFrame:
    """(token, fp, n, pos, size) of prefix shingles that two or more distinct sets share.

    ``pos`` counts from 0 in the order rare to frequent, ``size`` is the length of the list. Blocks of
    about ``BUCKET_ROWS`` postings are dealt by shingle, those of very frequent shingles by set, so no
    block grows with one key. The postings of one of those lie in many blocks, so they are all kept
    there, with ``size`` 0, and counted by shingle afterwards. Postings that carry their marks and have no
    partner in their list (``partnered``) are left out.
    """
    spark = docs.sparkSession
    total = described.where("n > 0").agg(F.sum(F.expr(f"n - ceil(n * {rule.num} / {rule.den}) + 1"))).first()[0] or 0
    buckets = max(8, int(total) // BUCKET_ROWS + 1)
    ranks = rarity(described)
    classes = spark.sparkContext.broadcast(ranks)
    hot = int(4 * np.log2(HOT))
    kinds = ["<u8", "<i8", *["<u8"] * rule.carried, "<i4", "<i4"]

    def blocks_of(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        bucket, *columns = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edges))
        columns = [x[order] for x in columns]
        # the bytes of a small number lie apart, all first ones, all second ones: the upper ones are zeros and cost nothing
        planes = [x if x.itemsize == 8 else x.view("u1").reshape(-1, x.itemsize) for x in columns]
        blocks = [b"".join(c[edges[b]:edges[b + 1]].T.tobytes() for c in planes) for b in used]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        sent: set[int] = set()
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, 0):
                _, _, _, size, fp, tokens, offset = unit_sets(part.column(0), rule)
                fresh = np.zeros(len(fp), bool)
                some = np.flatnonzero(size > 0)
                prints, at = np.unique(fp[some], return_index=True)
                fresh[some[at]] = [f not in sent for f in prints.tolist()]
                sent.update(prints.tolist())
                if len(sent) > 500_000:
                    sent.clear()
                unit = np.repeat(np.arange(len(fp)), size)
                mine = fresh[unit]
                unit, tokens = unit[mine], tokens[mine]
                offset = np.concatenate([[0], np.cumsum(size * fresh)])
                bits = set_marks(tokens, offset, rule.carried).view(np.uint64) if rule.carried else np.zeros((len(fp), 0), np.uint64)
                cls = table[(tokens >> np.uint64(64 - BITS)).astype(np.int64)]
                order = np.argsort((unit.astype(np.int64) << 8) | cls, kind="stable")
                tokens, cls = tokens[order], cls[order]
                pos = np.arange(len(unit)) - offset[unit]
                pre = pos < rule.probe(size[unit])
                tokens, cls, unit, pos = tokens[pre], cls[pre], unit[pre], pos[pre]
                spread = np.where(cls >= hot, mix(fp[unit].view(np.uint64)), mix(tokens ^ _M3))
                bucket = (spread % np.uint64(buckets)).astype(np.int64)
                held.append([bucket, tokens, fp[unit], *[bits[unit, i] for i in range(rule.carried)], size[unit].astype("<i4"), pos.astype("<i4")])
                if sum(len(x[0]) for x in held) > HELD_ROWS:
                    yield blocks_of(held)
                    held = []
        if held:
            yield blocks_of(held)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        held: dict[int, list[bytes]] = {}
        width = sum(np.dtype(kind).itemsize for kind in kinds)
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(block)
        while held:
            _, blocks = held.popitem()
            parts: list[list[np.ndarray]] = [[] for _ in kinds]
            for block in blocks:
                m, at = len(block) // width, 0
                for i, kind in enumerate(kinds):
                    size = np.dtype(kind).itemsize
                    column = np.frombuffer(block, "u1", m * size, at)
                    parts[i].append(column.view(kind) if size == 8 else np.ascontiguousarray(column.reshape(size, m).T).view(kind).reshape(m))
                    at += m * size
            columns = [np.concatenate(p) for p in parts]
            order = np.lexsort((columns[1], columns[0]))
            columns = [x[order] for x in columns]
            once = np.ones(len(order), bool)
            once[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            token, fp, *bits, n, pos = (x[once] for x in columns)
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            size = np.repeat(np.diff(edges), np.diff(edges))
            spread = table[(token >> np.uint64(64 - BITS)).astype(np.int64)] >= hot
            keep = np.flatnonzero((size > 1) | spread)
            token, fp, n, pos = token[keep], fp[keep], n[keep].astype(np.int64), pos[keep].astype(np.int64)
            size = np.where(spread[keep], 0, size[keep])
            if rule.carried:
                keep = partnered(token, fp, n, pos, np.stack([x[keep] for x in bits], 1), size, rule)
                token, fp, n, pos, size = (x[keep] for x in (token, fp, n, pos, size))
            for a in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 100_000]) for x in (token.view(np.int64), fp, n, pos, size)], names=["token", "fp", "n", "pos", "size"])
            release()

    dealt = to_python(docs.select("text")).mapInArrow(deal, "bucket int, block binary").repartition(buckets, "bucket")
    found = materialise(dealt.mapInArrow(gather, "token long, fp long, n long, pos long, size long"), "postings")
    if not (np.frombuffer(ranks, np.uint8) >= hot).any():
        return found
    shared = found.where("size = 0").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    kept = found.where("size = 0").join(shared, "token", "left_semi").unionByName(found.where("size > 0"))
    kept = materialise(kept, "postings")
    discard(found)
    return kept


def marks_of(described: DataFrame, shared: DataFrame) -> DataFrame:
    """(fp, doc, line, bits) of the sets in ``shared``, once each, with the first unit that has the set."""
    wanted = shared.select("fp").distinct()
    units = described.where("slice is null and n > 0").select("fp", F.struct(F.coalesce("doc", F.lit(_NO_DOC)).alias("doc"), "line").alias("place"), "bits")
    first = units.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("place").alias("place"), F.first("bits").alias("bits"))
    return materialise(first.select("fp", "place.doc", "place.line", "bits"), "marks")


def candidates(docs: DataFrame, described: DataFrame, rule: Rule) -> DataFrame:
    """(token, fp, n, pos, doc, line, bits): shared postings that have a partner, those of one shingle side by side."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
            if not part:
                continue
            part = part[0]
            token = np.asarray(part.column(0))
            other = np.flatnonzero(token != token[-1])
            cut = other[-1] + 1 if len(other) else 0
            held = [part.slice(cut)]
            if len(token) - cut > LONG:
                held, cut = [], len(token)
            yield kept(part.slice(0, cut))
        for part in held:
            yield kept(part)
        release()

    def kept(part: pa.RecordBatch) -> pa.RecordBatch:
        token, fp, n, pos = (np.asarray(part.column(i)) for i in range(4))
        bits = np.asarray(part.column(6).flatten()).view(np.uint64).reshape(len(token), rule.marks)
        keep = partnered(token, fp, n, pos, bits, np.asarray(part.column(7)), rule)
        return part.select(range(7)).filter(pa.array(keep))

    with tidy_shuffles(docs.sparkSession):
        shared = postings(docs, described, rule)
        marks = marks_of(described, shared)
        sets = marks.count()
    rows = shared.join(bounded(marks, sets), "fp").select("token", "fp", "n", "pos", "doc", "line", "bits", "size")
    if sets > BROADCAST_ROWS:
        rows = rows.repartition("token").sortWithinPartitions("token")
    if not rule.carried:
        rows = to_python(rows, 50_000).mapInArrow(run, rows.drop("size").schema)
    rows = materialise(rows.select("token", "fp", "n", "pos", "doc", "line", "bits"), "candidates")
    discard(shared, marks)
    return rows


def near(rule: Rule, one: str = "a", other: str = "b") -> Column:
    """Whether the marks of two sets differ in no more bits than similar sets may differ in shingles."""
    apart = sum((F.bit_count(F.col(f"{one}_bits")[i].bitwiseXOR(F.col(f"{other}_bits")[i])) for i in range(rule.marks)), F.lit(0))
    total = F.col(f"{one}_n") + F.col(f"{other}_n")
    return apart <= total - 2 * F.ceil(total * rule.num / (rule.num + rule.den))


def passing(rule: Rule, small: str = "a", large: str = "b") -> Column:
    """Length and positional filters for two postings of one shingle, the smaller set's first.

    The smaller set must have the shingle in its index prefix; shingles before and after the
    shared one bound the overlap.
    """
    ns, nl, ps, pl = (F.col(f"{x}_{c}") for c in ("n", "pos") for x in (small, large))
    bound = F.least(ps, pl) + 1 + F.least(ns - ps, nl - pl) - 1
    return ((ps < ns - F.ceil(ns * (2 * rule.num) / (rule.num + rule.den)) + 1) & (ns * rule.den >= nl * rule.num)
            & (bound >= F.ceil((ns + nl) * rule.num / (rule.num + rule.den))))


def sized(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of postings ``x`` and ``y`` that pass the filters, the smaller set as ``a``, the larger as ``b``."""
    first = F.expr("struct(x_n, x) < struct(y_n, y)")
    pick = lambda c: [F.when(first, F.col(f"x{c}")).otherwise(F.col(f"y{c}")).alias(f"a{c}"),
                      F.when(first, F.col(f"y{c}")).otherwise(F.col(f"x{c}")).alias(f"b{c}")]
    return pairs.select("x", "y", *pick(""), *pick("_n"), *pick("_pos")).where(passing(rule))


def first_tries(shared: DataFrame, rule: Rule, by_place: bool, turn: int = 0, tries: int = 1) -> DataFrame:
    """``(x, a, b)``: for each set ``x`` at most ``tries`` pairs with it to verify first.

    Each list, of a shingle and a class of sizes within 4/3 of each other, offers its first ``tries`` sets to all
    members behind them: the smallest ones, with ``by_place`` the earliest, in a later ``turn`` others.
    A set tries those that most of its lists offer, of another ``label`` if there are labels; a set that is
    ``done`` tries none. Only sets whose marks are near are offered. Lists are read in batches as they lie; where a batch cuts a list, each part offers
    its own sets, which costs a test more or less but no link, as all remaining pairs are tried later.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, fp, n, pos, doc, line, label = (np.asarray(batch.column(i)) for i in range(7))
            done = batch.column(7).to_numpy(zero_copy_only=False)
            bits = np.asarray(batch.column(8).flatten()).view(np.uint64).reshape(len(token), rule.marks)
            if not len(token):
                continue
            size_class = np.floor(np.log(n) / np.log(4 / 3)).astype(np.int64)
            rank = mix(fp.view(np.uint64) ^ np.uint64(turn)) if turn else n
            order = np.lexsort(((fp, line, doc) if by_place else (fp, rank)) + (size_class, token))
            token, fp, n, pos, size_class, label, done = (c[order] for c in (token, fp, n, pos, size_class, label, done))
            bits = bits[order]
            start = np.ones(len(token), bool)
            start[1:] = (token[1:] != token[:-1]) | (size_class[1:] != size_class[:-1])
            head = np.flatnonzero(start)[np.cumsum(start) - 1]
            found = []
            for step in range(tries):
                x = np.flatnonzero(~done & (np.arange(len(token)) > head + step))
                if not len(x):
                    break
                y = head[x] + step
                small = (n[x] < n[y]) | ((n[x] == n[y]) & (fp[x] < fp[y]))
                a, b = np.where(small, x, y), np.where(small, y, x)
                ok = ((label[x] != label[y]) & (pos[a] < rule.index(n[a])) & (n[a] * rule.den >= n[b] * rule.num)
                      & (np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= rule.overlap(n[a] + n[b])))
                x, a, b = x[ok], a[ok], b[ok]
                ok = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= n[a] + n[b] - 2 * rule.overlap(n[a] + n[b])
                x, a, b = x[ok], a[ok], b[ok]
                rows, count = np.unique(np.stack([fp[x], fp[a], fp[b]], 1), axis=0, return_counts=True)
                found.append(np.concatenate([rows, count[:, None]], 1))
            rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)], names=["x", "a", "b", "c"])
            release()

    given = {"label": F.col("fp"), "done": F.lit(False)}
    columns = ["token", "fp", "n", "pos", "doc", "line", *[c if c in shared.columns else given[c].alias(c) for c in given], "bits"]
    offers = to_python(shared.select(*columns), 50_000).mapInArrow(run, "x long, a long, b long, c long")
    offers = offers.groupBy("x", "a", "b").agg(F.sum("c").alias("c"))
    if tries == 1:
        best = offers.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("p")).select("x", "p.a", "p.b")
    else:
        most = W.partitionBy("x").orderBy(F.desc("c"), "a", "b")
        best = offers.withColumn("r", F.row_number().over(most)).where(F.col("r") <= tries).select("x", "a", "b")
    return best


def chained(rows: DataFrame) -> DataFrame:
    """Postings with ``prev``, the shingle before in the same set's list.

    Two sets that share a shingle and the one before it meet there already, so a pair is needed
    only where their ``prev`` differ.
    """
    return rows.withColumn("prev", F.lag("token").over(W.partitionBy("fp").orderBy("pos")))


def _at_places(docs: DataFrame, places: DataFrame, count: int) -> DataFrame:
    """(text, doc, lines) of the rows of ``docs`` whose doc_id is among the ``places`` (doc, line), ``count`` at most.

    Where there are too many places for a broadcast, other texts go before the shuffle, if the ids alone may be broadcast.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC))
    source = docs.select(key.alias("doc"), "text")
    if BROADCAST_ROWS < count <= 8 * BROADCAST_ROWS:
        source = source.join(F.broadcast(places.select("doc").distinct()), "doc", "left_semi")
    lines = places.groupBy("doc").agg(F.collect_set("line").alias("lines"))
    return source.join(bounded(lines, count), "doc").select("text", "doc", "lines")


def _units_at(part: pa.RecordBatch, rule: Rule):
    """Fingerprints and lines of the asked units of ``_at_places`` rows, and their shingles with offsets."""
    row, line, _, size, fp, tokens, offset = unit_sets(part.column(0), rule)
    asked = [set(x) for x in part.column(2).to_pylist()]
    some = np.array([u for u in np.flatnonzero(size > 0).tolist() if line[u] in asked[row[u]]], np.int64)
    return some, row, line, fp, tokens, offset


def sets_of(docs: DataFrame, places: DataFrame, count: int, rule: Rule) -> DataFrame:
    """(fp, tokens) of the sets at ``places`` (doc, line), ``count`` at most, read from their first units."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                some, _, _, fp, tokens, offset = _units_at(part, rule)
                yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array([tokens[offset[i]:offset[i + 1]].tobytes() for i in some], pa.binary())], names=["fp", "tokens"])

    return to_python(_at_places(docs, places, count)).mapInArrow(run, "fp long, tokens binary")


def long_marks(tokens: np.ndarray) -> bytes:
    """The size of a set, and its marks of two bits or more a shingle, a power of two; halves laid over each other are the marks of half the bits."""
    least, most = LONG_BITS
    bits = min(most, max(least, 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens ^ _M2) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.int64(len(tokens)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def long_near(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    """Whether two ``long_marks``, as 64-bit words, differ in no more bits than similar sets may differ in shingles."""
    total = int(x[0]) + int(y[0])
    x, y = x[1:], y[1:]
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= total - 2 * rule.overlap(total)


def long_marks_of(docs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """(fp, doc, line, long) of the sets in ``rows`` (doc, line), read from their first units; marked for broadcast if small."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                some, row, line, fp, tokens, offset = _units_at(part, rule)
                doc = part.column(1).take(pa.array(row[some]))
                yield pa.RecordBatch.from_arrays([pa.array(fp[some]), doc, pa.array(line[some].astype(np.int32)), pa.array([long_marks(tokens[offset[i]:offset[i + 1]]) for i in some], pa.binary())],
                                                 names=["fp", "doc", "line", "long"])

    places = rows.select("doc", "line").distinct()
    found = to_python(_at_places(docs, places, places.select("doc").distinct().count())).mapInArrow(run, "fp long, doc long, line int, long binary")
    found = materialise(found.groupBy("fp").agg(F.min(F.struct("doc", "line", "long")).alias("one")).select("fp", "one.*"), "long")
    size = found.agg(F.sum(F.octet_length("long"))).first()[0] or 0
    small = bounded(found, size, MARK_BYTES)
    small.scratch = found.scratch
    return small


def narrowed(pairs: DataFrame, marks: DataFrame, rule: Rule, tag: str) -> DataFrame:
    """(a, b, a_doc, a_line, b_doc, b_line): the distinct ``pairs`` (a, b) that may link by their sets' long ``marks``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column(6), batch.column(7))
            keep = [long_near(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), rule) for x, y in ends]
            yield batch.select(range(6)).filter(pa.array(keep, pa.bool_()))

    end = lambda x: marks.select(F.col("fp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("doc", "line", "long")])
    full = pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", "a_doc", "a_line", "b_doc", "b_line", "a_long", "b_long")
    return materialise(to_python(full).mapInArrow(run, full.drop("a_long", "b_long").schema), tag)


def linked(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Those of the ``narrowed`` pairs that link; their sets are read for this, each once, and not kept."""
    places = pairs.select(F.inline(F.array(*[F.struct(F.col(f"{x}_doc").alias("doc"), F.col(f"{x}_line").alias("line")) for x in "ab"])))
    return verify(pairs, sets_of(docs, places, 2 * pairs.count(), rule), rule)


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of fingerprints that link: all shingles of both ``sets`` are counted.

    A pair's sets are sent to one place, once each; sets without a pair are not sent.
    """
    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if rule.den * both >= rule.num * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    own = lambda x: F.max(F.when(F.col("fp") == F.col(x), F.col("tokens"))).alias(f"{x}_tokens")
    full = sets.join(bounded(ends, 2 * pairs.count()), "fp").groupBy("a", "b").agg(own("a"), own("b"))
    return materialise(to_python(full, 200).mapInArrow(exact, "a long, b long"), "links")
