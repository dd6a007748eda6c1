from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cataloom.streaming import jobs


def drain(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    finished = query.awaitTermination(60)
    query.stop()
    assert finished
    return df.sparkSession.table(name)


PUSHES = "code string, updated_at timestamp, items array<string>"


def push(spark, path, rows):
    spark.createDataFrame(rows, PUSHES).coalesce(1).write.mode("append").parquet(path)


def run_lists(spark, tmp_path, **given):
    stream = spark.readStream.schema(PUSHES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.store_lists(jobs.latest_lists(stream, **given), str(tmp_path / "out"), str(tmp_path / "ck"))
    finished = query.awaitTermination(120)
    query.stop()
    assert finished
    return {r.code: (r["items"], r.deleted) for r in jobs.read_lists(spark, str(tmp_path / "out")).collect()}


def test_latest_lists_keep_the_newest_push(spark, tmp_path):
    now, path = datetime(2026, 1, 1), str(tmp_path / "in")
    push(spark, path, [("123-456", now, ["a"]), ("123456", now + timedelta(hours=1), ["b", "c"]), ("12", now, ["x"]), ("654321", now, ["d"])])
    push(spark, path, [("123456", now - timedelta(hours=2), ["late"])])
    assert run_lists(spark, tmp_path, max_items=1) == {"123456": ('["b"]', False), "654321": ('["d"]', False)}


def test_lists_expire_and_are_given_as_deleted(spark, tmp_path):
    """Time passes with the pushes of others, over restarts of the stream; a new push puts the end off or starts a list again."""
    now, path = datetime(2026, 1, 1), str(tmp_path / "in")
    push(spark, path, [("111111", now, ["a"]), ("222222", now, ["b"])])
    assert run_lists(spark, tmp_path, ttl_days=30) == {"111111": ('["a"]', False), "222222": ('["b"]', False)}
    push(spark, path, [("222222", now + timedelta(days=20), ["b2"])])
    push(spark, path, [("no code", now + timedelta(days=32), [])])
    assert run_lists(spark, tmp_path, ttl_days=30) == {"111111": ('["a"]', True), "222222": ('["b2"]', False)}
    push(spark, path, [("111111", now + timedelta(days=33), ["new"])])
    push(spark, path, [("no code", now + timedelta(days=52), [])])
    assert run_lists(spark, tmp_path, ttl_days=30) == {"111111": ('["new"]', False), "222222": ('["b2"]', True)}
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "newest").load()
    assert [r["key"]["code"] for r in state.collect()] == ["111111"]


def test_monthly_counter_stream_matches_batch(spark, small, tmp_path):
    orders = spark.read.parquet(f"{small}/orders.parquet").select(F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") != "F").alias("ok"))
    path = str(tmp_path / "orders")
    orders.write.parquet(path)
    stream = spark.readStream.schema(orders.schema).parquet(path)
    got = drain(jobs.monthly_counter(stream), "months", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.monthly_counter(orders).collect()))


def test_daily_usage_drops_late_and_repeated_requests(spark, tmp_path):
    start, path, schema = datetime(2026, 1, 30), str(tmp_path / "in"), "request_id int, ts timestamp, ok boolean"

    def feed(*rows):
        spark.createDataFrame([(i, start + timedelta(hours=h), ok) for i, h, ok in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = jobs.store_usage(jobs.daily_usage(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert query.awaitTermination(120)
        return {str(r.month): r.used for r in jobs.read_months(spark, str(tmp_path / "out")).collect()}

    feed((1, 1, True), (2, 2, False), (3, 30, True), (1, 5, True))
    feed((3, 31, True), (4, 20, True))
    assert run() == {"2026-01-01": 3}
    feed((5, 24 * 6, True))
    # Six days on, hour 3 is late, and ids of the first days are forgotten.
    feed((6, 3, True), (7, 24 * 6, True))
    assert run() == {"2026-01-01": 3, "2026-02-01": 2}
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("operatorId", "1").load()
    assert {r["key"]["request_id"] for r in state.collect() if "request_id" in r["key"]} <= {5, 7}


def test_refused_snapshots_are_kept_in_quarantine(spark, tmp_path):
    from cataloom.operators.quality import DatasetRules
    from cataloom.sources import publish

    inbox, root, rules = str(tmp_path / "inbox"), str(tmp_path / "root"), DatasetRules(min_rows=3, baseline_rows=3, max_count_change_pct=1e9, max_turnover_pct=1e9)
    for n in (3, 2, 5):
        rows = spark.range(n).selectExpr("'s' || id as slug", f"{'cast(null as string)' if n == 2 else repr('c')} as city", "52.0D as lat", "5.0D as lon", "'active' as status", "0 as consecutive_missing")
        jobs.announce(rows, str(tmp_path / f"snap{n}"), inbox)
    for _ in range(2):
        jobs.ingest_snapshots(jobs.read_arrivals(spark, inbox), root, str(tmp_path / "ck"), rules).awaitTermination()
    first = publish.read_versions(spark, root).orderBy("seq").collect()
    assert [r.row_count for r in first] == [3, 5]
    held = publish.read_quarantine(spark, root).collect()
    assert [(r.path[-5:], r.failed_rules) for r in held] == [("snap2", ["completeness"])]
