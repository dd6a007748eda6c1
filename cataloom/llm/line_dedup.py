"""Line dedup: an exact set-similarity join of lines that removes later matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, tidy_shuffles
from .common import bounded
from .setjoin import Rule, candidates, chained, describe, first_tries, near, sets_of, sized, verify

LINES = Rule(lines=True)
#: Early sets of its lists that each set is tried against, turn by turn, before all earlier ones.
TRIES = (1, 16)


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("token", F.col("fp").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "pos", "doc", "line", "prev", "bits")])


def _open_lists(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Postings of the shingles that a set not done yet shares with an earlier one, with whether their own set is done."""
    marked = rows.join(done.select(F.col("x").alias("fp"), F.lit(True).alias("done")), "fp", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    place = F.struct("doc", "line", "fp")
    wanted = marked.groupBy("token").agg(F.min(place).alias("low"), F.max(F.when(~F.col("done"), place)).alias("high")).where("low < high").select("token")
    return materialise(marked.join(wanted, "token", "left_semi"), "open")


def matched_sets(docs: DataFrame, described: DataFrame, rule: Rule) -> DataFrame:
    """``fp`` of every shingle set that is similar to a set seen earlier; sets of one place are ordered by ``fp``.

    Each set is first tried against early sets of its posting lists, more of them from turn to turn; sets that
    match are done. The others are tried against all earlier sets of their lists, so none is missed and a
    group of similar lines costs a few tests a line, also where only some of its pairs match.
    """
    left = candidates(docs, described, rule)
    places = left.select("doc", "line").distinct()
    sets = materialise(sets_of(docs, places, places.select("doc").distinct().count(), rule), "tokens")
    done = None
    for tries in TRIES:
        best = materialise(first_tries(left, rule, by_place=True, tries=tries), "tried")
        found = verify(best.select("a", "b").distinct(), sets, rule)
        new = best.join(found, ["a", "b"]).select("x").distinct()
        done = materialise(new if done is None else done.unionByName(new).distinct(), "matched")
        before, left = left, _open_lists(left.drop("done"), done)
        discard(before, best, found)
    linked = materialise(chained(left), "chained")
    rest = _side(linked.where("not done"), "x")
    pairs = sized(rest.join(_side(linked, "y"), "token")
                  .where("struct(y_doc, y_line, y) < struct(x_doc, x_line, x) and coalesce(x_prev <> y_prev, true)").where(near(rule, "x", "y")),
                  rule).select("x", "a", "b").distinct()
    pairs = materialise(pairs, "crossing")
    more = pairs.join(verify(pairs.select("a", "b").distinct(), sets, rule), ["a", "b"]).select("x").distinct()
    discard(sets, left, linked)
    return done.unionByName(more).select(F.col("x").alias("fp")).distinct()


def removed_lines(docs: DataFrame, rule: Rule = LINES) -> DataFrame:
    """``(doc_id, print, lines)``: the numbers, from 0, of the lines of a text that match an earlier line.

    ``print`` is the xxhash64 of the text. Lines are ordered by (doc_id, line), null doc_ids last;
    lines of different texts with one doc_id and number are ordered by their sets, then by
    ``print``. A line goes if an earlier line has the same set of shingles or one that ``rule``
    calls similar, be that line kept or not. Lines without words never go. Rows that repeat both
    doc_id and text count as one place in the order: their lines go or stay together.
    """
    described = describe(docs, rule)
    with tidy_shuffles(docs.sparkSession):
        matched = matched_sets(docs, described, rule)
    units = described.where("slice is null and n > 0").select("doc", "print", "line", "fp")
    key = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), F.col("line").alias("line"), F.col("print").alias("print"))
    often = units.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp")
    many = units.join(often, "fp", "left_semi").groupBy("fp").agg(F.min(key).alias("first"))
    found = many.join(matched.withColumn("similar", F.lit(True)), "fp", "full")
    lines = units.join(found, "fp").where(F.coalesce("similar", F.lit(False)) | (key > F.col("first")))
    gone = lines.groupBy("doc", "print").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    gone = materialise(gone.select(F.col("doc").alias("doc_id"), "print", "lines"), "removed")
    discard(described)
    return gone


def dedup_lines(docs: DataFrame, rule: Rule = LINES) -> DataFrame:
    """``docs`` with later lines taken out of ``text``, and ``n_lines``, ``n_removed``, ``removed``.

    Lines end with a line feed. ``removed`` holds the numbers of the lines taken out. A null text
    has no lines and stays null; all other columns stay, except that the three named ones
    replace columns of the same name. A row loses only lines of its own text, also where its
    doc_id is null or other texts share it.
    """
    gone = removed_lines(docs, rule)
    gone = bounded(gone, gone.count()).select(
        F.col("doc_id").alias("__llm_gone_id"), F.col("print").alias("__llm_gone_print"), F.col("lines").alias("__llm_gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__llm_gone_id")) & (F.xxhash64("text") == F.col("__llm_gone_print"))
    joined = docs.select(*names).join(gone, own, "left")
    joined = joined.withColumn("__llm_split", F.when(F.col("__llm_gone").isNotNull(), F.split("text", "\n")))
    joined = joined.withColumn("__llm_gone", F.array_intersect(F.sequence(F.lit(0), F.size("__llm_split") - 1), F.col("__llm_gone")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__llm_split") - 1), F.col("__llm_gone")), lambda i: F.get(F.col("__llm_split"), i))
    text = F.when(F.col("__llm_split").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    removed = F.when(F.col("__llm_split").isNull(), F.array().cast("array<int>")).otherwise(F.col("__llm_gone"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
