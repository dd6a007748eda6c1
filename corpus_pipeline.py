"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage but the last returns the columns of its input; the last one returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.common import read
from cataloom.llm.decontaminate import clean_documents
from cataloom.llm.line_dedup import dedup_lines
from cataloom.llm.ngram_join import keep_first
from cataloom.llm.packing import pack_documents
from cataloom.llm.queries import tokenizer
from cataloom.llm.toxicity import toxicity
from cataloom.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    judged = toxicity(docs, read(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those that lose all their words this way go.

    ``n_chars`` follows the text. Documents that had no words before stay.
    """
    names = docs.columns
    found = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    packed = pack_documents(docs, tokenizer("word_bpe_49k.json"), keep=("ids_crc32",))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can neither fit the classifier nor tokenize; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    rows = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialise(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
