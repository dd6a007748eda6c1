"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

DataFrame functions only. A window is the unit of containment: all its shingles must be found
in order. Its prefix for full containment is one shingle, the rarest one in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from .common import bounded

#: Fixed by the task: what separates words, and the words of a window and of a shingle.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingle that stands for the document itself; no word contains it.
_SELF = "\u0001"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter touched; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _shingles(array: str, width: int) -> Column:
    """Structs (pos, token) of all runs of ``width`` words; ``array`` names the column of words."""
    many = F.transform(F.sequence(F.lit(1), F.size(array) - width + 1),
                       lambda i: F.struct((i - 1).cast("int").alias("pos"), F.array_join(F.slice(array, i, width), " ").alias("token")))
    return F.when(F.size(array) >= width, many).otherwise(F.array().cast("array<struct<pos:int,token:string>>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, win, len)``: each item's windows as text, or the whole item where it is shorter."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = cut.withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return (cut.select("item_id", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))).alias("win"))
            .distinct())


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows of ``items`` occur in ``docs``.

    Returns one row per document text (doc_id, print, n_words, copies), all occurrences
    (doc_id, print, start, len, win), and the items of each window (item_id, win).
    """
    named = materialise(item_windows(items, window), "items")
    windows = materialise(named.select("win", "len").distinct().withColumn("w", F.split("win", " "))
                          .withColumn("k", F.least("len", F.lit(shingle))), "windows")
    widths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most ``shingle`` values
    parts = [windows.where(F.col("k") == k).select("win", "len", "k", F.explode(_shingles("w", k)).alias("s")) for k in widths]
    tokens = windows.select("win", "len", "k", F.lit(0).alias("offset"), F.lit("").alias("token")).limit(0)
    for part in parts:
        tokens = tokens.unionByName(part.select("win", "len", "k", F.col("s.pos").alias("offset"), "s.token"))
    tokens = materialise(tokens, "shingles")
    distinct = tokens.select("token").distinct().unionByName(docs.sparkSession.createDataFrame([(_SELF,)], "token string"))
    rows = tokens.count() + 1

    own = F.array(F.struct(F.lit(-1).cast("int").alias("pos"), F.lit(_SELF).alias("token")))
    split = docs.select(F.col("doc_id"), F.xxhash64("text").alias("print"), words(F.col("text")).alias("w"))
    every = F.concat(own, *[_shingles("w", k) for k in widths])
    spread = split.select("doc_id", "print", F.size("w").cast("long").alias("n_words"), F.explode(every).alias("s"))
    hits = materialise(spread.select("doc_id", "print", "n_words", "s.pos", "s.token").join(bounded(distinct, rows), "token"), "hits")

    is_self = F.col("token") == _SELF
    texts = hits.where(is_self).groupBy("doc_id", "print", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    hits = hits.where(~is_self)
    counts = materialise(hits.groupBy("token").agg(F.count(F.lit(1)).alias("seen")), "rarity")
    # A shingle that no document has counts 0: its windows cannot occur.
    ranked = tokens.join(bounded(counts, rows), "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = (ranked.groupBy("win", "len", "k").agg(F.min(F.struct("seen", "token", "offset")).alias("r"))
              .where("r.seen > 0").select("win", "len", "k", "r.token", "r.offset"))
    prefix = materialise(prefix, "prefix")
    start = (F.col("pos") - F.col("offset")).cast("int")
    tried = (hits.join(bounded(prefix, rows), "token").withColumn("start", start)
             .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))))
    # Exact check: shingles side by side from the window's start, and the one at its end, cover its words.
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("len") - F.col("k"), F.col("k")), F.array(F.col("len") - F.col("k"))))
    need = tried.select("doc_id", "print", "start", "len", "k", "win", F.size(offsets).alias("parts"), F.explode(offsets).alias("o"))
    split_win = F.split("win", " ")
    need = need.select("doc_id", "print", "start", "len", "win", "parts", (F.col("start") + F.col("o")).alias("pos"),
                       F.array_join(F.slice(split_win, F.col("o") + 1, F.col("k")), " ").alias("token")).distinct()
    there = hits.select(F.col("doc_id").alias("_id"), "print", "pos", "token").distinct()
    met = need.join(there, F.col("doc_id").eqNullSafe(F.col("_id")) & (need["print"] == there["print"]) & (need["pos"] == there["pos"]) & (need["token"] == there["token"]))
    found = (met.groupBy("doc_id", need["print"], "start", "len", "win", "parts").agg(F.count(F.lit(1)).alias("c"))
             .where("c = parts").select("doc_id", "print", "start", "len", "win"))
    return texts, materialise(found, "occurrences"), named


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text; more columns are ignored. A word is
    hit if it is inside an occurrence of a window. Null and empty texts have no words and are
    never hit; null item texts have no windows; a null item_id is not listed. Rows that repeat
    doc_id and text are judged alike and all returned; other texts of a doc_id are judged apart.
    """
    texts, found, named = occurrences(docs, items, window, shingle)
    end = F.col("start") + F.col("len")
    before = F.max(end).over(W.partitionBy("doc_id", "print").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1))
    spans = found.select("doc_id", "print", "start", "len").distinct()
    spans = spans.select("doc_id", "print", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("fresh"))
    hit = spans.groupBy("doc_id", "print").agg(F.sum("fresh").cast("long").alias("n_hit"))
    listed = found.select("doc_id", "print", "win").distinct().join(bounded(named, named.count()), "win")
    listed = listed.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    judged = hit.join(listed.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (hit["print"] == listed["print"]), "left")
    judged = judged.select(F.col("doc_id").alias("_id"), hit["print"].alias("_print"), "n_hit", "items")
    full = texts.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    items_text = F.coalesce(F.array_join("items", ","), F.lit(""))
    out = full.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(items_text, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "copies")
    out = out.withColumn("n_items", F.greatest(F.col("n_items"), F.lit(0)))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "col")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of an item."""
    _, found, _ = occurrences(docs, items)
    bad = found.select(F.col("doc_id").alias("__llm_id"), F.col("print").alias("__llm_print")).distinct()
    bad = bounded(bad, bad.count())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.xxhash64("text") == F.col("__llm_print")), "left_anti")
