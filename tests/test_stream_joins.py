import datetime as dt

from pyspark.sql import functions as F

from paperloom.streaming import joins

SCHEMA = "event_id long, ts timestamp, user_id long, kind string"


def at(minutes):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)


def put(spark, folder, rows):
    """rows: (event_id, minute, user_id, kind), as one more file."""
    spark.createDataFrame([(i, at(m), u, k) for i, m, u, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def joined(rows, how="inner"):
    once = joins.delivered_once(rows, "event_id", late="30 minutes")
    results, corrections = once.where("kind = 'result'"), once.where("kind = 'correction'")
    return joins.corrected(results, corrections, "user_id", "60 minutes", how=how).select("event_id", "c_event_id")


def run(spark, tmp_path, how="inner"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    joins.run_available(joined(stream, how), f"{tmp_path}/out-{how}", f"{tmp_path}/ck-{how}").awaitTermination()
    return sorted((r.event_id, r.c_event_id or 0) for r in spark.read.schema("event_id long, c_event_id long").parquet(f"{tmp_path}/out-{how}").collect())


def test_stream_equals_the_table_over_restarts(spark, tmp_path):
    batches = [
        [(1, 0, 7, "result"), (2, 5, 8, "result"), (3, 6, None, "result")],
        [(4, 20, 7, "correction"), (1, 0, 7, "result"), (5, 61, 7, "correction"), (6, 25, None, "correction")],
        [(7, 60, 7, "correction"), (4, 20, 7, "correction"), (8, 66, 8, "correction"), (9, 65, 8, "correction")],
    ]
    for rows in batches:
        put(spark, f"{tmp_path}/in", rows)
        got = run(spark, tmp_path)  # each run restarts from the checkpoint
        table = joined(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        assert got == sorted((r.event_id, r.c_event_id) for r in table.collect())
    assert got == [(1, 4), (1, 7), (2, 9)]


def test_late_rows_and_unmatched_results(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 7, "result"), (2, 1, 9, "result")])
    put(spark, f"{tmp_path}/in", [(3, 10, 7, "correction"), (4, 500, 1, "result"), (5, 500, 1, "correction")])
    assert run(spark, tmp_path, "left_outer") == [(1, 3), (2, 0), (4, 5)]  # 2 can no longer be corrected
    put(spark, f"{tmp_path}/in", [(6, 12, 7, "correction"), (7, 13, 7, "result"), (8, 505, 1, "correction")])
    assert run(spark, tmp_path, "left_outer") == [(1, 3), (2, 0), (4, 5), (4, 8)]  # 6 and 7 are late


def test_plan_keeps_bounded_state(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 7, "result")])
    rows = joined(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert rows.isStreaming and "EventTimeWatermark" in plan and "DeduplicateWithinWatermark" in plan
    assert not joins.delivered_once(spark.range(1).select(F.col("id").alias("event_id")), "event_id").isStreaming
