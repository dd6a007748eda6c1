"""N-gram Jaccard join: near-duplicate documents on sets of five-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, tidy_shuffles
from .common import components
from .setjoin import Rule, candidates, chained, describe, first_tries, linked, long_marks_of, narrowed, near, passing

#: Sets of its lists that each set is tried against, turn by turn, before all remaining pairs.
TRIES = (1, 16, 16)


def _groups(links: DataFrame, before: DataFrame | None) -> DataFrame:
    """(fp, label) of the sets that ``links`` (a, b) and the groups ``before`` join, with the least set of each group."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if before is not None:
        edges = edges.unionByName(before.select(F.col("fp").alias("u"), F.col("label").alias("v")))
    return components(edges).select(F.col("node").alias("fp"), F.col("component").alias("label"))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with the group of their set so far, of those shingles that sets of several groups share."""
    rows = rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    return materialise(rows.join(mixed, "token", "left_semi"), "mixed")


def _crossing(rows: DataFrame, rule: Rule) -> DataFrame:
    """All candidate pairs of ``chained`` rows whose sets are in different groups so far."""
    side = lambda x: rows.select("token", F.col("fp").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "pos", "prev", "label", "bits")])
    index = side("a").where(F.expr(f"a_pos < a_n - ceil(a_n * {2 * rule.num} / {rule.num + rule.den}) + 1"))
    pairs = (index.join(side("b"), "token")
             .where("a_label <> b_label and (a_n < b_n or a_n = b_n and a < b) and coalesce(a_prev <> b_prev, true)").where(passing(rule)).where(near(rule)))
    return pairs.select("a", "b").distinct()


def _named(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, print, n, key) of each row: its text's 64-bit hash, the size of its set and its component's key."""
    described = describe(docs, rule)
    left = candidates(docs, described, rule)
    marks = long_marks_of(docs, left, rule)
    groups = None
    for turn, tries in enumerate(TRIES):
        pairs = narrowed(first_tries(left, rule, False, turn, tries).select("a", "b").distinct(), marks, rule, "tried")
        links = linked(docs, pairs, rule)
        older, groups = groups, materialise(_groups(links, groups), "labels")
        before, left = left, _mixed(left.drop("label"), groups)
        discard(before, pairs, links, *([older] if older else []))
    rows = materialise(chained(left), "chained")
    pairs = narrowed(_crossing(rows, rule), marks, rule, "crossing")
    discard(left, rows, marks)
    links = linked(docs, pairs, rule)
    labels = _groups(links, groups)
    units = described.where("slice is null").select("doc", "print", "n", "fp")
    named = units.join(labels, "fp", "left").withColumn("key", F.coalesce("label", "fp"))
    named = materialise(named.select("doc", "print", "n", "key"), "named")
    discard(described, groups, pairs, links)
    return named


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs`` (doc_id, text; more columns are ignored).

    Two documents link when ``rule`` holds for their sets of distinct shingles; a component is
    what links reach, named by its smallest doc_id. Equal sets are one set from the start. Each
    set is first tried against some sets of other groups in its posting lists, more of them from turn to turn
    (``TRIES``); pairs inside the groups found so need no test, and all remaining candidate pairs whose
    marks are near are verified once. So a large group of copies costs a few tests per member, also where only some of its
    pairs link, and no link between groups is lost.

    Null or blank texts have an empty set and link with nothing. A null doc_id keeps its row;
    its group is named by the smallest doc_id that is not null, if any. Rows that repeat a
    doc_id are separate documents of one name.
    """
    with tidy_shuffles(docs.sparkSession):
        named = _named(docs, rule)
    least = named.where("n > 0").groupBy("key").agg(F.min("doc").alias("least"))
    full = named.where("n > 0").join(least, "key").select("doc", "n", "least")
    return full.unionByName(named.where("n = 0").select("doc", "n", F.col("doc").alias("least"))).select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id (null last), of several the smallest text hash.

    A row goes by its own doc_id and text, so a document that only shares its doc_id with a duplicate stays.
    Of rows that repeat both, one stays. Rows without words all stay.
    """
    with tidy_shuffles(docs.sparkSession):
        named = _named(docs, rule).where("n > 0")
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("print").alias("print"))
    firsts = named.groupBy("key").agg(F.min(place).alias("first"))
    rows = named.join(firsts, "key").groupBy(F.col("doc").alias("__llm_id"), F.col("print").alias("__llm_print")).agg(
        F.min(place != F.col("first")).alias("__llm_later"), (F.count(F.lit(1)) > 1).alias("__llm_often"))
    marked = materialise(rows.where("__llm_later or __llm_often"), "later")
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("__llm_id")) & (F.xxhash64(docs["text"]) == F.col("__llm_print"))
    kept = docs.join(marked, own, "left").where("not coalesce(__llm_later, false)")
    if not marked.where("__llm_often and not __llm_later").isEmpty():
        kept = kept.where("__llm_often is null").unionByName(kept.where("__llm_often").dropDuplicates(["__llm_id", "__llm_print"]))
    return kept.select(*docs.columns)
