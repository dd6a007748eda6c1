"""Faults of conversations and their cheapest repair into ``(system? (user assistant)+)?``.

A repair is a shortest path over the turns with the states nothing, system, user and assistant. The
weight of a path is one integer: its high digits are the cost, its low digits of three bits each spell
the edits made so far, with zeros behind the last one, so that the ordinary least integer is the cheapest
repair whose letters come first in ASCII. After WINDOW turns the letters are written down and
replaced by the rank of each state's path among the four, which keeps the integers short and the order
exact: two paths over the same turns that both end in a turn's letter are equal or differ before either ends.

Turns are numbered by a distributed sort. The search reads only initials and faults, as a stream in
turn order; texts meet the edits again in a join on unique positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import rank_rows
from ..session import materialise

#: Turns between two times that letters are written down.
WINDOW = 64
_BITS = 3
_LETTERS = " DIKR"
_D, _I, _K, _R = range(1, 5)
_WIDTH = _BITS * (2 * WINDOW + 3)
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {(_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The role that an inserted or renamed turn must have.
_FORCED = "uuau"
_ROLES = {"u": "user", "a": "assistant"}

_SEEN = r"[^\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with the faults that the crc32 of ``conv_id:turn`` modulo 20 asks for.

    0 drops a row, 1 empties its text, 2 removes its full stops and other end marks, 3 repeats it, 4
    makes its role ``user``. Nulls are taken as one space.
    """
    def given(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(given("text"), "[.!?]", "")).otherwise(given("text"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(given("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def mark_faults(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> adds ``place`` in the conversation, from 0, and its first ``fault``.

    Turns ascend by number (null first), those of one number by role and text. A null role or text is
    one space. Faults: ``blank`` (no visible character), ``duplicate`` (role and text seen before), ``truncated``
    (the last visible character ends no sentence), else null. A null conv_id is one conversation.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("_g"), "conv_id", "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rank_rows(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["_g"]).withColumn("place", F.col("rank") - 1).drop("rank")
    print_ = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = rows.groupBy("_g", print_.alias("_print")).agg(F.min("place").alias("place")).select("_g", "place", F.lit(True).alias("_first"))
    blank = ~F.col("text").rlike(_SEEN)
    cut = ~F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(F.col("_first").isNull(), "duplicate").when(cut, "truncated")
    return materialise(rows.join(firsts, ["_g", "place"], "left").withColumn("fault", fault).drop("_first"), "turns")


class _Search:
    """The search over one conversation, fed turn by turn."""

    def __init__(self):
        start = 1 << (_WIDTH - _BITS)
        #: Per state: weight, letters used in this window, and written windows as (earlier, letters).
        self.best: list = [(start, 1, None), None, None, None]
        self.turns: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.numbers = 0
        self.first = self.last = self.before = None

    def feed(self, turn, initial: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.numbers += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.turns.append(initial)
        broken, cut = fault in ("blank", "duplicate"), int(fault == "truncated")
        reached = list(self.best)
        for state in range(4):
            self._offer(reached, _NEXT[state, _FORCED[state]], _edit(self.best[state], 2, _I))
        after: list = [None] * 4
        for state in range(4):
            path = reached[state]
            if path is None:
                continue
            self._offer(after, state, _edit(path, 3, _D))
            if not broken:
                if (state, initial) in _NEXT:
                    self._offer(after, _NEXT[state, initial], _edit(path, cut, _K))
                self._offer(after, _NEXT[state, _FORCED[state]], _edit(path, 2 + cut, _R))
        self.best = after
        if len(self.turns) % WINDOW == 0:
            self._write_down()

    @staticmethod
    def _offer(at: list, state: int, path) -> None:
        if path is not None and (at[state] is None or path[0] < at[state][0]):
            at[state] = path

    def _write_down(self) -> None:
        low = (1 << _WIDTH) - 1
        order = sorted({p[0] & low for p in self.best if p is not None})
        rank = {digits: i + 1 for i, digits in enumerate(order)}
        self.best = [p and ((p[0] >> _WIDTH << _WIDTH) + (rank[p[0] & low] << (_WIDTH - _BITS)), 1, (p[2], _spelled(p))) for p in self.best]

    def end(self) -> tuple[int, str]:
        """Cost and letters of the cheapest repair."""
        last = list(self.best)
        self._offer(last, _ASSISTANT, _edit(last[_USER], 2, _I))
        path = min((last[s] for s in (_NOTHING, _ASSISTANT) if last[s] is not None), key=lambda p: p[0])
        parts, written = [_spelled(path)], path[2]
        while written is not None:
            written, letters = written
            parts.append(letters)
        return path[0] >> _WIDTH, "".join(reversed(parts))


def _edit(path, cost: int, letter: int):
    """The path with one more edit, None for none."""
    if path is None:
        return None
    weight, used, written = path
    return weight + (cost << _WIDTH) + (letter << (_WIDTH - _BITS * (used + 1))), used + 1, written


def _spelled(path) -> str:
    weight, used, _ = path
    return "".join(_LETTERS[(weight >> (_WIDTH - _BITS * (i + 1))) & 7] for i in range(1, used))


def _edits(audit: str, initials: list[str]) -> Iterator[tuple[str, str]]:
    """Per turn, its letters (inserts before it; behind the last one too) and the initials they lead to, ``-`` for none."""
    state, letters, targets, row = _NOTHING, "", "", 0
    tail = len(audit.rstrip("I"))
    for at, letter in enumerate(audit):
        target = "-" if letter == "D" else initials[row] if letter == "K" else _FORCED[state]
        state = state if letter == "D" else _NEXT[state, target]
        letters, targets = letters + letter, targets + target
        if letter != "I" and at + 1 < tail:
            yield letters, targets
            letters, targets, row = "", "", row + 1
    if letters:
        yield letters, targets


_PLAN = ("_g string, place long, edits string, targets string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]


def find_repairs(marked: DataFrame) -> DataFrame:
    """Rows of `mark_faults` -> per turn its edits, and per conversation a row without a place that holds its report.

    Each conversation passes one task as a stream of initials; its texts stay where they are.
    """
    names = [part.split()[0] for part in _PLAN.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=names)

    def finished(group: str, search: _Search) -> Iterator[pa.RecordBatch]:
        cost, audit = search.end()
        rows = []
        for place, (letters, targets) in enumerate(_edits(audit, search.turns)):
            rows.append((group, place, letters, targets, *[None] * 7))
            if len(rows) == 5000:
                yield batch(rows)
                rows = []
        gaps = search.last - search.first + 1 - search.numbers if search.numbers else 0
        rows.append((group, None, None, None, gaps, *search.counts.values(), search.illegal, cost, audit))
        yield batch(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, search, ready, waiting = None, None, [], 0
        for part in batches:
            for g, turn, initial, fault in zip(*[c.to_pylist() for c in part.columns]):
                if g != group:
                    if search is not None:
                        for done in finished(group, search):
                            ready.append(done)
                            waiting += done.num_rows
                            if waiting >= 5000:
                                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                                ready, waiting = [], 0
                    group, search = g, _Search()
                search.feed(turn, initial, fault)
        if search is not None:
            ready.extend(finished(group, search))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    narrow = marked.select("_g", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "place")
    ordered = narrow.repartition(F.col("_g")).sortWithinPartitions("_g", "place").drop("place")
    return materialise(ordered.mapInArrow(run, _PLAN), "repairs")


def repaired_turns(marked: DataFrame, repairs: DataFrame) -> DataFrame:
    """(_g, conv_id, place, step, edit, role, text) of the turns that stay or are put in, in order of place and step."""
    edits = repairs.where("place is not null").select("_g", "place", "edits", "targets")
    letters = F.transform(F.sequence(F.lit(1), F.char_length("edits")), lambda i: F.struct(
        i.alias("step"), F.substring("edits", i, F.lit(1)).alias("edit"), F.substring("targets", i, F.lit(1)).alias("target")))
    rows = marked.join(edits, ["_g", "place"]).select("_g", "conv_id", "place", "role", "text", F.inline(letters)).where("edit <> 'D'")
    named = F.when(F.col("edit") == "K", F.col("role"))
    for initial, role in _ROLES.items():
        named = named.when(F.col("target") == initial, role)
    return rows.select("_g", "conv_id", "place", "step", "edit", named.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def text_digests(turns: DataFrame) -> DataFrame:
    """(_g, sha256) of the lines ``role:text`` of repaired turns, joined by new lines, hashed as they stream by."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = None, None
        for part in batches:
            groups, digests = [], []
            for g, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if g != group:
                    if digest is not None:
                        groups.append(group)
                        digests.append(digest.hexdigest())
                    group, digest = g, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            if groups:
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(digests, pa.string())], names=["_g", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([digest.hexdigest()])], names=["_g", "sha256"])

    lines = turns.select("_g", F.concat("role", F.lit(":"), "text").alias("line"), "place", "step")
    ordered = lines.repartition(F.col("_g")).sortWithinPartitions("_g", "place", "step").select("_g", "line")
    return ordered.mapInArrow(run, "_g string, sha256 string")


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct conv_id of ``conversations``: faults, cost, edits and the hash of the repaired text.

    A conversation without turns has zeros, no edits and the hash of an empty text; so has an empty table no
    rows. Repeated turns are duplicates; extra columns are not read.
    """
    marked = mark_faults(turns)
    repairs = find_repairs(marked)
    report = repairs.where("place is null").drop("place", "edits", "targets")
    digests = text_digests(repaired_turns(marked, repairs))
    every = conversations.select("conv_id").distinct().withColumn("_g", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    found = every.join(report, "_g", "left").join(digests, "_g", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
