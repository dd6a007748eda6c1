"""Agreement of two independent extractions, escalation and change classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import contains_any
from .gates import mapped_free_for, quote_in_text, safety_net
from ..functions.text import match_norm_loose

ANSWER_FIELDS = ("status", "price", "door", "online", "cheapest", "variants", "quote", "source_url", "page_title", "free_for", "note", "reason")


def near(a: Column, b: Column) -> Column:
    """Equal to the cent; false when either side is unknown."""
    return F.coalesce(F.abs(a.cast("decimal(18,2)") - b.cast("decimal(18,2)")) < F.lit("0.01").cast("decimal(18,2)"), F.lit(False))


def pair_answers(extractions: DataFrame, key: str = "slug", model: str = "model", first: int | str = 1, second: int | str = 2, seq: str | None = None) -> DataFrame:
    """One row per key with both answers side by side; one aggregate instead of a self-join.

    Of several answers of one model the last by ``seq`` holds, and without it, or where it is equal, the
    one whose text as JSON comes first, so that the order of the rows decides nothing.
    """
    answer = F.struct(*[c for c in extractions.columns if c not in (key, model, seq)])
    text = F.to_json(answer, {"ignoreNullFields": "false"})
    order = F.struct(F.lit(0) if seq is None else -F.col(seq).cast("double"), text)

    def of(which):
        return F.min_by(answer, F.when(F.col(model) == which, order))

    return extractions.groupBy(key).agg(of(first).alias("m1"), of(second).alias("m2"))


def check_both(pairs: DataFrame, compat: bool = True) -> DataFrame:
    """Add fails1 and fails2 for rows holding m1, m2, website and page_text (text read once)."""
    df = pairs.withColumn("_norm", match_norm_loose(F.col("page_text")))
    df = df.withColumn("_q1", F.col("m1.quote")).withColumn("_q2", F.col("m2.quote"))
    df = quote_in_text(df, "_q1", "_norm", "_f1", normalised=True)
    df = quote_in_text(df, "_q2", "_norm", "_f2", normalised=True)
    for i in (1, 2):
        df = df.withColumn(f"fails{i}", safety_net(F.col(f"m{i}"), F.col("website"), F.col("_norm"), F.coalesce(f"_f{i}", F.lit(False)), compat))
    return df.drop("_norm", "_q1", "_q2", "_f1", "_f2")


def agree(df: DataFrame) -> DataFrame:
    """Add is_agreed, disagreement_type, fallback and agreed_price from m1, m2, fails1, fails2."""
    ok1, ok2 = F.size("fails1") == 0, F.size("fails2") == 0
    s1, s2, p1, p2 = F.col("m1.status"), F.col("m2.status"), F.col("m1.price"), F.col("m2.price")
    priced = ("paid", "free", "closed")
    waiting = (s1 == "retry_later") | (s2 == "retry_later")
    same = near(p1, p2)
    door = near(F.col("m2.door"), p1) | near(F.col("m1.door"), p2)
    kind = (F.when(waiting, "retry_later")
            .when(ok1 & ok2 & ~s1.eqNullSafe(s2), "status_mismatch")
            .when(ok1 & ok2 & (s1 == "paid") & ~same & ~door, "price_mismatch")
            .when(ok1 & ok2 & ~s1.isin(*priced), "both_unknown")
            .when(ok1 & ok2, F.lit(None))
            .when(ok1 & s1.isin(*priced), F.lit(None))
            .when(ok2 & s2.isin(*priced), F.lit(None))
            .when(~ok1, "gate_failure_model1").otherwise("gate_failure_model2"))
    fallback = F.when(kind.isNull() & ok1 & ~ok2, 1).when(kind.isNull() & ok2 & ~ok1, 2)
    price = F.when(F.col("fallback") == 2, p2).when(F.col("fallback") == 1, p1).when(same, p1).otherwise(F.least(p1, p2))
    return (df.withColumn("disagreement_type", kind).withColumn("is_agreed", F.col("disagreement_type").isNull())
            .withColumn("fallback", fallback.cast("int"))
            .withColumn("agreed_price", F.when(F.col("is_agreed"), price)))


def agreement_confidence(df: DataFrame) -> DataFrame:
    reasons = F.lower(F.concat_ws(" ", F.coalesce("m1.reason", F.lit("")), F.coalesce("m2.reason", F.lit(""))))
    value = (F.when(~F.col("is_agreed"), "low").when(F.col("fallback").isNotNull(), "medium")
             .when(contains_any(reasons, vocab.TIER_REASON_WORDS), "medium").otherwise("high"))
    return df.withColumn("confidence", value)


def _truthy(c: Column, kind: str) -> Column:
    """Zero and empty text count as missing."""
    return F.when(c != 0, c) if kind == "number" else F.nullif(c, F.lit(""))


def merge_agreed(df: DataFrame, mode: str = "dual_model") -> DataFrame:
    """Add the ``record`` struct: chosen answer first, then model 1, then model 2, per field.

    Variant maps are rebuilt from entries with model 2 winning, so no session setting about
    duplicate map keys is needed.
    """
    second = F.col("fallback") == 2

    def pick(field: str, kind: str = "text") -> Column:
        one, two = _truthy(F.col(f"m1.{field}"), kind), _truthy(F.col(f"m2.{field}"), kind)
        return F.when(second, F.coalesce(two, one)).otherwise(F.coalesce(one, two))

    agreed = F.col("is_agreed")

    def only(value: Column) -> Column:
        return F.when(agreed, value)

    status = F.when(~agreed, "needs_review").when(second, F.col("m2.status")).otherwise(F.col("m1.status"))
    door, online = pick("door", "number"), pick("online", "number")
    online = F.when(online.isNull() & door.isNotNull() & (status == "paid"), F.col("agreed_price")).otherwise(online)
    empty = F.create_map().cast("map<string,decimal(9,2)>")
    v1, v2 = F.coalesce("m1.variants", empty), F.coalesce("m2.variants", empty)
    variants = F.map_concat(F.map_filter(v1, lambda k, _: ~F.coalesce(F.map_contains_key(v2, k), F.lit(False))), v2)
    free_for = F.array_union(mapped_free_for(F.col("m1.free_for")), mapped_free_for(F.col("m2.free_for")))
    record = F.struct(
        status.alias("status"), only(F.col("agreed_price")).alias("price"), only(door).alias("door"), only(online).alias("online"),
        only(F.when(F.size(F.map_keys(variants)) > 0, variants)).alias("variants"),
        only(pick("cheapest", "number")).alias("cheapest"), only(pick("note")).alias("note"),
        F.when(agreed, F.array_sort(free_for)).otherwise(F.array().cast("array<string>")).alias("free_for"),
        pick("quote").alias("quote"), F.coalesce(pick("source_url"), F.col("website")).alias("source_url"),
        F.coalesce(pick("page_title"), F.lit("")).alias("page_title"), F.coalesce(pick("reason"), F.lit("")).alias("reason"),
        F.concat(F.lit(mode), F.coalesce(F.concat(F.lit("_fallback_m"), F.col("fallback").cast("string")), F.lit(""))).alias("mode"),
        F.col("confidence").alias("confidence"))
    return df.withColumn("record", record)


def consensus(gates_passed: Column, verdict: Column) -> Column:
    coerced = F.when(verdict.isin(*vocab.VERDICTS), verdict).otherwise("unsure")
    return F.coalesce(gates_passed, F.lit(False)) & (coerced == "confirm")


def escalation_select(attempts: DataFrame, key: str = "slug") -> DataFrame:
    """attempts(key, attempt 1|2, gates_passed, verdict, failures, value): accepted attempt per key.

    The second attempt counts only when the first was rejected; when both fail, the second's
    failures follow the first's, marked.
    """
    row = F.struct("gates_passed", "verdict", "failures", "value")
    wide = attempts.groupBy(key).agg(F.first(F.when(F.col("attempt") == 1, row), ignorenulls=True).alias("a"),
                                     F.first(F.when(F.col("attempt") == 2, row), ignorenulls=True).alias("b"))
    first, second = consensus(F.col("a.gates_passed"), F.col("a.verdict")), consensus(F.col("b.gates_passed"), F.col("b.verdict"))
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("a.failures", none), F.transform(F.coalesce("b.failures", none), lambda f: F.concat(F.lit("Escalation failed: "), f)))
    failures = F.when(first, F.coalesce("a.failures", none)).when(second, none).otherwise(both)
    return wide.select(key, (first | second).alias("is_accepted"), (~first & second).alias("escalated"),
                       F.when(~first & second, F.col("b.value")).otherwise(F.col("a.value")).alias("value"), failures.alias("failures"))


def recheck_delta(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """old(key, status, price) accepted before; new(key, is_accepted, status, price) now."""
    before = old.select(key, F.struct("status", "price").alias("_o"))
    joined = new.join(before, key, "left").withColumnRenamed("price", "new_price")
    known, was, now = F.col("_o").isNotNull(), F.col("_o.price"), F.col("new_price")
    same = F.col("status").eqNullSafe(F.col("_o.status"))
    equal = (was.isNull() & now.isNull()) | near(was, now)
    both_paid = (F.col("status") == "paid") & (F.col("_o.status") == "paid")
    delta = (F.when(known & F.col("is_accepted") & same & equal, "unchanged")
             .when(known & F.col("is_accepted") & both_paid & ~now.eqNullSafe(was), "price_changed")
             .when(known & F.col("is_accepted"), "status_changed")
             .when(known, "became_unavailable")
             .when(F.col("is_accepted"), "newly_resolved").otherwise("still_unresolved"))
    text = F.concat_ws(" -> ", F.concat_ws(" ", F.col("_o.status"), was.cast("string")), F.concat_ws(" ", F.col("status"), now.cast("string")))
    return joined.select(key, F.col("_o.status").alias("prev_status"), was.alias("prev_price"), F.col("status").alias("new_status"),
                         "new_price", delta.alias("delta_type"), text.alias("delta_desc"))


def delta_report(deltas: DataFrame, by: str = "delta_type") -> DataFrame:
    return deltas.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
