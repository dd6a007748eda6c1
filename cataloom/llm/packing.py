"""Best-fit packing of token pieces by swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import extended, slices, to_python
from .tokens import Encoder, appended

CAPACITY, END = 4096, 1
#: Pieces that one pool packs together, and the rounds in which left-over bins meet in new pools.
POOL = 20_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: token ids of every text and ``end``, cut every ``capacity`` ids.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is ``end`` alone.
    """
    docs = docs.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                ids, offsets = appended(*encoder.encode(part.column(1)), end)
                count = np.diff(offsets)
                many = -(-count // capacity)
                row = np.repeat(np.arange(len(count)), many)
                piece = np.arange(len(row)) - (np.cumsum(many) - many)[row]
                start = piece * capacity
                length = np.minimum(capacity, count[row] - start)
                at = offsets[:-1][row] + start
                raw = ids.astype("<u4")
                blobs = [raw[a:a + n].tobytes() for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(blobs, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return to_python(docs, 1000).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


class _Bins:
    """Underfull bins of one pool during the search, indexed by fill and by what they can give back.

    For each room, ``sums`` maps every length that one or two items of such a bin have together
    to those bins, and ``masks`` holds a bit for each of these lengths.
    """

    def __init__(self, items: list[list[int]], capacity: int):
        self.items, self.capacity = [sorted(x) for x in items], capacity
        self.fill = [sum(x) for x in items]
        self.by_fill: list[tuple[int, int]] = []
        self.rooms: list[int] = []
        self.sums: dict[int, dict[int, dict[int, None]]] = {}
        self.masks: dict[int, int] = {}
        for b in range(len(items)):
            self.add(b)

    def returns(self, b: int) -> set[int]:
        """Lengths of one item, or of two, of a bin."""
        own = self.items[b]
        lengths = sorted(set(own))
        twice = {x for x, y in zip(own, own[1:]) if x == y}
        found = set(lengths)
        for i, x in enumerate(lengths):
            found.update(x + y for y in lengths[i + 1:])
            if x in twice:
                found.add(2 * x)
        return found

    def add(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        insort(self.by_fill, (self.fill[b], b))
        if room not in self.sums:
            insort(self.rooms, room)
            self.sums[room], self.masks[room] = {}, 0
        sums, mask = self.sums[room], 0
        for x in self.returns(b):
            if x in sums:
                sums[x][b] = None
            else:
                sums[x] = {b: None}
                mask |= 1 << x
        self.masks[room] |= mask

    def drop(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_fill.pop(bisect_left(self.by_fill, (self.fill[b], b)))
        sums, mask = self.sums[room], 0
        for x in self.returns(b):
            del sums[x][b]
            if not sums[x]:
                del sums[x]
                mask |= 1 << x
        self.masks[room] ^= mask
        if not sums:
            self.rooms.pop(bisect_left(self.rooms, room))
            del self.sums[room], self.masks[room]

    def put(self, b: int, take: list[int], give: list[int]) -> None:
        for x in take:
            self.items[b].remove(x)
        for x in give:
            insort(self.items[b], x)
        self.fill[b] += sum(give) - sum(take)

    def exchange(self, item: int, fill: int) -> tuple[int, list[int]] | None:
        """The bin, at least ``fill`` full, that gains most by ``item`` for one or two smaller items, and these."""
        best, found = 0, None
        for i in range(bisect_right(self.rooms, min(self.capacity - fill, item - 1)) - 1, -1, -1):
            room = self.rooms[i]
            if room <= best:
                break
            mask = self.masks[room] >> (item - room)
            low = (mask & -mask).bit_length() - 1
            if mask and room - low > best:
                best, found = room - low, (room, item - room + low)
        if found is None:
            return None
        room, back = found
        target = next(iter(self.sums[room][back]))
        own = self.items[target]
        k = bisect_left(own, back)
        if k < len(own) and own[k] == back:
            return target, [back]
        for a, x in enumerate(own):
            k = bisect_left(own, back - x, a + 1)
            if k < len(own) and own[k] == back - x:
                return target, [x, own[k]]
        raise AssertionError("the index names a sum that the bin does not hold")


def improve(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer or equally many bins with the same item lengths.

    Bins are taken from the emptiest on. Its items move into the fullest bin with room, or are
    exchanged, one for one or two for one, against smaller items of a bin at least as full, the
    one that gains most; either raises the sum of squared fills. Bins that empty are dropped,
    bins that are or become full are out of the search. It ends when no such step is left.
    """
    full = [x for x in bins if sum(x) == capacity]
    s = _Bins([x for x in bins if sum(x) < capacity], capacity)
    alive = set(range(len(s.items)))

    def given(target: int, take: list[int], give: list[int]) -> None:
        s.drop(target)
        s.put(target, take, give)
        if s.fill[target] == capacity:
            alive.discard(target)
            full.append(s.items[target])
        else:
            s.add(target)

    changed = True
    while changed:
        changed = False
        for source in sorted(alive, key=lambda b: (s.fill[b], b)):
            if source not in alive:
                continue
            s.drop(source)
            for item in sorted(s.items[source], reverse=True):
                # move: the fullest bin that has room
                i = bisect_right(s.by_fill, (capacity - item, len(s.items))) - 1
                if i >= 0 and s.by_fill[i][0] + item > s.fill[source]:
                    s.put(source, [item], [])
                    given(s.by_fill[i][1], [], [item])
                    changed = True
                    continue
                best = s.exchange(item, s.fill[source])
                if best:
                    target, back = best
                    s.put(source, [item], back)
                    given(target, back, [item])
                    changed = True
            if s.items[source]:
                s.add(source)
            else:
                alive.discard(source)
    return full + [s.items[b] for b in sorted(alive)]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of ``lengths`` (1 to ``capacity``): best fit from the longest on, then ``improve``."""
    groups: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        groups.setdefault(int(lengths[i]), []).append(i)
    room: dict[int, list[int]] = {}
    levels: list[int] = []
    bins: list[list[int]] = []
    for length in sorted(groups, reverse=True):
        for _ in groups[length]:
            k = bisect_left(levels, length)
            if k < len(levels):
                left = levels[k]
                b = room[left].pop()
                if not room[left]:
                    levels.pop(k)
                    del room[left]
            else:
                left, b = capacity, len(bins)
                bins.append([])
            bins[b].append(length)
            left -= length
            if left:
                if left not in room:
                    room[left] = []
                    insort(levels, left)
                room[left].append(b)
    bins = improve(bins, capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, held in enumerate(bins):
        at = 0
        for length in held:
            i = groups[length].pop()
            where[i], offset[i] = b, at
            at += length
    return where, offset


def pack(items: DataFrame, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """``items`` (length, and any other columns) with ``sequence_id`` and ``offset``.

    Rows are dealt at random to pools of about ``pool`` rows, so each task's work is bounded; a
    pool that is packed leaves a few underfull bins at most. The rows of bins that are not
    nearly full meet once more in pools of their own. Every row is placed; offsets in a sequence
    have no gaps. Columns named sequence_id or offset are replaced. No rows give no rows.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    # Written once, so that rows keep their pools if a task is run again.
    dealt = materialise(items.select(*names), "pieces")
    total = dealt.count()
    pools = max(1, -(-total // pool))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in names]) + F.monotonically_increasing_id(), F.lit(pools)).cast("int")

    def run_pools(final: bool):
        def run(table: pa.Table) -> pa.Table:
            lengths = np.asarray(table["length"], np.int64)
            where, offset = pack_lengths(lengths, capacity)
            fill = np.bincount(where, weights=lengths)
            loose = np.zeros(len(lengths), bool) if final else fill[where] < 0.98 * capacity
            base = np.asarray(table["__llm_pool"], np.int64) * (2 * pool * 64) + (1 << 62) * final
            out = table.drop_columns(["__llm_pool"]).append_column("sequence_id", pa.array(base + where)).append_column("offset", pa.array(offset))
            return out if final else out.append_column("__llm_loose", pa.array(loose))

        return run

    first = (dealt.withColumn("__llm_pool", salt).groupBy("__llm_pool")
             .applyInArrow(run_pools(False), extended(dealt.schema, sequence_id="long", offset="long", __llm_loose="boolean")))
    first = materialise(first, "packed")
    loose = first.where("__llm_loose").select(*names)
    left = loose.count()
    again = max(1, -(-left // pool))
    plain = extended(dealt.schema, sequence_id="long", offset="long")
    second = (loose.withColumn("__llm_pool", F.pmod(F.xxhash64(*[F.col(c) for c in names]) + F.monotonically_increasing_id(), F.lit(again)).cast("int"))
              .groupBy("__llm_pool").applyInArrow(run_pools(True), plain))
    return first.where("not __llm_loose").drop("__llm_loose").unionByName(second)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Pieces of ``docs`` (see ``pieces``) and their places (see ``pack``).

    ``keep`` may leave out ``ids``, or name ``ids_crc32``, their unsigned crc32, to move less.
    """
    cut = pieces(docs, path, capacity, end).withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut.select("doc_id", "piece", "start", "length", *keep), capacity)
