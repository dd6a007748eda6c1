"""Publishing snapshots, the changelog and run records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import fingerprint, rank_rows

#: ``seq`` counts published versions, whatever they are called; ``origin`` names what a version was made from.
MANIFEST = "version string, row_count bigint, hash_xor bigint, hash_sum decimal(38,0), seq bigint, origin string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return spark.createDataFrame([], schema)
        raise


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version named by the manifest's newest row."""
    row = _newest(spark, root)
    return None if row is None else row.version


def _newest(spark: SparkSession, root: str):
    order = F.struct(F.coalesce("seq", F.lit(0)), "version")
    return _table(spark, f"{root}/manifest", MANIFEST).agg(F.max_by(F.struct("*"), order).alias("m")).first().m


def published_from(spark: SparkSession, root: str, origin: str) -> bool:
    """Whether a version made from ``origin`` was published already."""
    return not _table(spark, f"{root}/manifest", MANIFEST).where(F.col("origin") == origin).isEmpty()


def read_published(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/data/{version}")


def read_published_in_order(spark: SparkSession, root: str) -> DataFrame | None:
    """The published rows with their ``position`` in the order they were sorted in when published."""
    version = current_version(spark, root)
    return None if version is None else read_in_order(spark.read.parquet(f"{root}/data/{version}"), f"{root}/data/{version}")


def publish_if_changed(df: DataFrame, root: str, version: str, origin: str | None = None) -> bool:
    """Write ``df`` as a new version only when its content differs from the current one.

    The manifest row is appended after the data is complete, so readers and retries only ever
    see whole snapshots. The fingerprint is one row; nothing else reaches the driver.
    """
    spark = df.sparkSession
    print_row = fingerprint(df).first()
    last = _newest(spark, root)
    if last is not None and (last.row_count, last.hash_xor, last.hash_sum) == (print_row.row_count, print_row.hash_xor, print_row.hash_sum):
        return False
    df.write.mode("overwrite").parquet(f"{root}/data/{version}")
    record_order(spark.read.parquet(f"{root}/data/{version}"), f"{root}/data/{version}")
    entry = spark.createDataFrame([(version, print_row.row_count, print_row.hash_xor, print_row.hash_sum, (last.seq or 0) + 1 if last else 1, origin)], MANIFEST)
    entry.write.mode("append").parquet(f"{root}/manifest")
    return True


#: One row for each snapshot that the gates refused, with the stream, batch and place of its notice.
QUARANTINE = "stream string, batch bigint, place int, path string, active_count bigint, failed_rules array<string>"


def quarantine(verdict: DataFrame, root: str, stream: str, batch: int, place: int, path: str) -> None:
    """Keep a refused snapshot's notice and verdict; a batch run again writes the same folder again."""
    row = verdict.select(F.lit(stream).alias("stream"), F.lit(batch).cast("bigint").alias("batch"), F.lit(place).alias("place"),
                         F.lit(path).alias("path"), F.col("active_count").cast("bigint").alias("active_count"), "failed_rules")
    row.write.mode("overwrite").parquet(f"{root}/quarantine/notice={stream.replace(':', '-').replace('/', '-')}-{batch}-{place}")


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/quarantine", QUARANTINE)


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, row_count, seq, origin) of all published versions."""
    return _table(spark, f"{root}/manifest", MANIFEST).select("version", "row_count", "seq", "origin")


def append_changelog(entry: DataFrame, keys: DataFrame, root: str, version: str) -> None:
    """Header rows (counts) and, beside them, one row per changed key, in folders of the version.

    A run repeated after a failure writes the same folders again.
    """
    entry.write.mode("overwrite").parquet(f"{root}/changelog/version={version}")
    keys.where("change in ('added', 'restored', 'removed')").write.mode("overwrite").parquet(f"{root}/changelog_keys/version={version}")


def read_changelog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/changelog").drop("version").orderBy(F.desc("timestamp"))


def write_report(report: DataFrame, root: str, version: str) -> None:
    report.write.mode("overwrite").parquet(f"{root}/report/version={version}")


def read_report(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(section, metric, key, detail, value) of the refresh that was published, or found unchanged, as ``version``."""
    return spark.read.parquet(f"{root}/report/version={version}")


def run_meta(catalog: DataFrame, last_checked: str, build_id: str) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("total_count")).select(
        F.lit(last_checked).cast("timestamp").alias("last_checked"), F.lit(build_id).alias("build_id"), "total_count")


def record_order(files: DataFrame, path: str) -> None:
    """Write beside the folder ``path`` which place each of its part files has, with its number of rows.

    ``files`` is the folder read back; its parts were written by a global sort, so their numbers are their order.
    """
    name = F.col("_metadata.file_name")
    parts = files.select(name.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("part")
    parts.select("file", part, "row_count").write.mode("overwrite").parquet(f"{path}_order")


def read_in_order(files: DataFrame, path: str, out: str = "position") -> DataFrame:
    """Rows of the folder with their 1-based place in the order recorded for it, however tasks share the files out."""
    order = files.sparkSession.read.parquet(f"{path}_order").select(F.col("file").alias("_file"), F.col("part").alias("_part"))
    placed = files.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    ranked = rank_rows(placed.join(F.broadcast(order), "_file"), [F.col("_part"), F.col("_block"), F.col("_line")], out="_rank")
    return ranked.select(F.col("_rank").alias(out), *files.columns)


_CSV = {"header": True, "escape": '"', "lineSep": "\r\n"}


def write_csv(rows: DataFrame, path: str) -> None:
    """Spreadsheet export: byte-order mark, header, quoted text, CRLF line ends.

    Rows are sorted by the first two columns (owner and rank) across the part files; their order is recorded.
    """
    rows = rows.orderBy(*rows.columns[:2])
    named = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    named.write.mode("overwrite").options(quoteAll=True, **_CSV).csv(path)
    record_order(_csv_files(rows.sparkSession, path, named.columns), path)


def _csv_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.options(**_CSV).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The exported rows as text, with their ``position``."""
    return read_in_order(_csv_files(spark, path, columns), path)
