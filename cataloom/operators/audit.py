"""Reports, samples and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.prices import wilson_interval


def paid_only(df: DataFrame) -> DataFrame:
    return df.where((F.col("status") == "paid") | (F.coalesce(F.col("price"), F.lit(0)) > 0))


def audit_sample(df: DataFrame, n: int, seed: str = "0", paid: bool = False, key: str = "slug") -> DataFrame:
    """Repeatable random rows: the ``n`` smallest seeded hashes, then ordered by price."""
    rows = paid_only(df) if paid else df
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    price = F.when(F.col("status") == "free", F.lit(0)).otherwise(F.coalesce(F.when(F.col("price") != 0, F.col("price")), F.lit(9999)))
    sampled = rows.withColumn("_h", order).orderBy("_h", key).limit(n).drop("_h")
    return sampled.withColumn("sort_price", price.cast("decimal(9,2)")).orderBy("sort_price", key)


def status_class(status: Column, price: Column) -> Column:
    return (F.when((status == "paid") | (F.coalesce(price, F.lit(0)) != 0), "paid")
            .when((status == "free") | (price == 0), "free").when(status == "closed", "closed").otherwise("other"))


def status_report(df: DataFrame) -> DataFrame:
    """Rows per status class with average, least and greatest amount of paid rows."""
    kind = status_class(F.col("status"), F.col("price"))
    amount = F.when(F.col("status_class") == "paid", F.col("price"))
    return df.withColumn("status_class", kind).groupBy("status_class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(amount), 2).cast("decimal(18,2)").alias("avg_price"), F.min(amount).alias("min_price"), F.max(amount).alias("max_price"))


def failure_class(text: Column, classes: Sequence[tuple[str, str]] = vocab.FAILURE_CLASSES) -> Column:
    low, out = F.lower(text), F.lit(None).cast("string")
    for phrase, name in reversed(classes):
        out = F.when(F.contains(low, F.lit(phrase)), F.lit(name)).otherwise(out)
    return out


def failure_histogram(review: DataFrame, failures: str = "failures", verdict: str = "verdict", status: str = "status") -> DataFrame:
    """Each failure counts under its first class; a row without any class counts once by its verdict."""
    classes = F.array_compact(F.transform(F.coalesce(failures, F.array().cast("array<string>")), lambda f: failure_class(f)))
    other = (F.when(F.col(verdict) == "reject", "verifier_rejected")
             .when(F.col(status) == "blocked_by_bot_protection", "bot_protection").otherwise("unspecified_review"))
    labels = F.when(F.size(classes) > 0, classes).otherwise(F.array(other))
    return review.select(F.explode(labels).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def run_summary(results: DataFrame) -> DataFrame:
    """(metric, n): totals, accepted by status, review by disagreement, waiting rows."""
    status, ok = F.col("status"), F.col("is_accepted")
    kind = F.coalesce(F.nullif("disagreement_type", F.lit("")), F.lit("unknown"))
    retry, quota = F.coalesce(status == "retry_later", F.lit(False)), F.coalesce(status == "quota_exhausted", F.lit(False))
    review = ~ok & ~retry & ~quota
    labels = F.array_compact(F.array(
        F.lit("total_processed"), F.when(ok, "accepted_total"),
        F.when(ok & status.isin("paid", "free", "closed"), F.concat(F.lit("accepted_"), status)).when(ok & (status == "blocked_by_bot_protection"), "accepted_blocked"),
        F.when(review, "needs_review_total"), F.when(review, F.concat(F.lit("needs_review_"), kind)),
        F.when(retry, "retry_later_total"), F.when(quota, "quota_exhausted_total")))
    return results.select(F.explode(labels).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


def identity_summary(df: DataFrame, status: str = "identity_status") -> DataFrame:
    s = F.col(status)
    return df.agg(F.count(F.lit(1)).alias("total_audited"), F.count_if(s == "match").alias("matches"), F.count_if(s == "weak_match").alias("weak_matches"),
                  F.count_if(s == "missing_website").alias("missing_website"), F.count_if(s == "suspicious").alias("suspicious_count"),
                  F.count_if(s.isin("fetch_failed", "blocked_by_bot_protection")).alias("fetch_failed_or_blocked"))


def mode_comparison(runs: DataFrame, modes: Sequence[str]) -> DataFrame:
    """runs(mode, is_accepted, calls, seconds) -> one row per metric, one column per mode."""
    n = F.count(F.lit(1))
    per_mode = runs.groupBy("mode").agg(
        n.alias("total"), F.count_if("is_accepted").alias("accepted"), F.count_if(~F.col("is_accepted")).alias("needs_review"),
        F.sum("calls").alias("calls"), F.round(F.sum("calls") / n, 2).alias("avg_calls"),
        F.round(F.sum("seconds"), 2).alias("seconds"), F.round(F.sum("seconds") / n, 2).alias("avg_seconds"))
    metrics = [c for c in per_mode.columns if c != "mode"]
    long = per_mode.select("mode", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(18,2)").alias("value")) for m in metrics])))
    return long.groupBy("metric").pivot("mode", list(modes)).agg(F.first("value"))


def cohort_metrics(cases: DataFrame, cohort: str = "cohort", subtypes: Sequence[str] = vocab.SEMANTIC_SUBTYPES) -> DataFrame:
    """Rates with Wilson bounds per cohort and combined.

    cases(cohort, category wrong|correct, subtype, gates_passed, verdict). A claim is confirmed
    when its gates pass and the verdict is confirm, otherwise rejected.
    """
    wrong, right = F.col("category") == "wrong", F.col("category") == "correct"
    confirmed = F.coalesce(F.col("gates_passed"), F.lit(False)) & F.coalesce(F.col("verdict") == "confirm", F.lit(False))
    caught = F.coalesce(F.col("verdict").isin("reject", "unsure"), F.lit(False))
    semantic = wrong & F.coalesce(F.col("subtype").isin(*subtypes), F.lit(False))
    counts = cases.rollup(cohort).agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(wrong).alias("wrong_count"), F.count_if(wrong & ~confirmed).alias("wrong_rejected"),
        F.count_if(right).alias("correct_count"), F.count_if(right & confirmed).alias("correct_confirmed"),
        F.count_if(semantic).alias("semantic_count"), F.count_if(semantic & caught).alias("semantic_rejected"),
        F.count_if(wrong & ~F.coalesce(F.col("gates_passed"), F.lit(False))).alias("gate_catches"), F.count_if(wrong & caught).alias("verifier_catches"),
        F.grouping(cohort).alias("_all"))
    out = counts.withColumn(cohort, F.when(F.col("_all") == 1, "combined").otherwise(F.col(cohort))).drop("_all")
    for name, k, n in (("rejection", "wrong_rejected", "wrong_count"), ("confirm", "correct_confirmed", "correct_count"), ("semantic", "semantic_rejected", "semantic_count")):
        ci = wilson_interval(F.col(k), F.col(n))
        rate = F.when(F.col(n) > 0, F.round(F.col(k) / F.col(n) * 100.0, 1)).otherwise(F.lit(0.0))
        out = out.withColumns({f"{name}_pct": rate, f"{name}_low": ci["low"], f"{name}_high": ci["high"]})
    return out
