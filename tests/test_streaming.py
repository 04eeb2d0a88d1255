import shutil
import tempfile
import time

import pytest
from pyspark.sql import functions as F, types as T

from raresift.streaming import flows, rates, stale


def test_conflicting_payload_stops_the_stream(spark):
    folder, sink, ckpt = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, h string")
    df.write.mode("overwrite").parquet(folder)
    stream = flows.landed(spark, folder, df.schema)
    with pytest.raises(Exception, match="different payloads"):
        flows.append_once(stream, ["k"], "h", sink, ckpt)


def test_resumed_stream_takes_only_new_files(spark):
    folder, sink, ckpt = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    df = spark.range(50)
    df.write.mode("overwrite").parquet(folder)
    known = spark.range(10).withColumnRenamed("id", "source_id")
    stream = lambda: flows.exclude_static(
        flows.landed(spark, folder, df.schema).withColumnRenamed("id", "source_id"), known
    )
    flows.run_available(stream(), sink, ckpt)
    assert spark.read.parquet(sink).count() == 40
    spark.range(100, 120).write.mode("append").parquet(folder)
    flows.run_available(stream(), sink, ckpt)
    assert spark.read.parquet(sink).agg(F.count("*"), F.count_distinct("source_id")).first() == (60, 60)


def _deliver(spark, folder, rows):
    spark.createDataFrame(rows, "k long, h string").coalesce(1).write.mode("append").parquet(folder)


def test_redelivery_adds_nothing_and_a_changed_payload_is_refused_in_a_later_batch(spark):
    folder, sink, ckpt = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))

    def run():
        stream = flows.landed(spark, folder, T.StructType.fromDDL("k long, h string"), files_per_trigger=1)
        flows.append_once(stream, ["k"], "h", sink, ckpt)

    _deliver(spark, folder, [(1, "a"), (2, "b"), (1, "a"), (None, "n")])
    run()
    _deliver(spark, folder, [(2, "b"), (3, "c"), (None, "n")])
    run()
    assert sorted(map(tuple, spark.read.parquet(sink).select("k", "h").collect()), key=str) == [
        (1, "a"), (2, "b"), (3, "c"), (None, "n")
    ]
    # Neither repeats nor changes are found by reading what was written: the state alone knows.
    shutil.rmtree(f"{sink}/batch=0")
    _deliver(spark, folder, [(1, "a"), (4, "d")])
    run()
    assert sorted(r.k for r in spark.read.parquet(sink).select("k").collect()) == [3, 4]
    _deliver(spark, folder, [(1, "changed")])
    with pytest.raises(Exception, match="different payloads"):
        run()
    assert spark.read.parquet(sink).count() == 2


def test_state_of_a_past_period_is_let_go(spark):
    folder, sink, ckpt = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    schema = "ts timestamp, k long, h string"

    def deliver(*rows):
        spark.sql("select cast(a as timestamp) ts, b k, c h from values " + ", ".join(f"('{a}', {b}L, '{c}') " for a, b, c in rows) + " v(a, b, c)").coalesce(
            1).write.mode("append").parquet(folder)
        stream = flows.event_time(flows.landed(spark, folder, T.StructType.fromDDL(schema), files_per_trigger=1), "ts", "1 hour")
        flows.append_once(stream, ["k"], "h", sink, ckpt, time="ts", period="1 day")

    deliver(("2024-01-01 10:00:00", 1, "a"), ("2024-01-01 11:00:00", 2, "b"))
    deliver(("2024-01-01 10:00:00", 1, "a"), ("2024-01-05 00:00:00", 3, "c"))
    deliver(("2024-01-05 01:00:00", 4, "d"), ("2024-01-01 10:00:00", 1, "changed"))  # the first day is closed by now
    assert sorted((r.k, r.h) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_rates_follow_event_time_over_batches(spark):
    folder, sink, ckpt = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    ends = [(f"b{k % 2}", k, 60_000 * (k + (5 if k % 7 == 0 else 0))) for k in range(120)]
    for at in (0, 40, 80):
        part = spark.createDataFrame(ends[at:at + 40][::-1], "build string, event_id long, ms long")
        part.withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read in the order of their times
    stream = flows.event_time(flows.landed(spark, folder, T.StructType.fromDDL("build string, event_id long, ms long, ts timestamp"), files_per_trigger=1), "ts", "10 minutes")
    with stale.rocksdb_state(spark):
        flows.run_available(rates.build_rates(stream, every=7, expected=100), sink, ckpt)
    want, closed = set(), max(ms for *_, ms in ends) - 600_000
    for build in ("b0", "b1"):
        own = sorted((ms, e) for b, e, ms in ends if b == build and ms <= closed)
        for n in range(7, len(own) + 1, 7):
            elapsed = (own[n - 1][0] - own[0][0]) / 1000
            want.add((build, n, own[n - 1][0], elapsed, n / elapsed * 3600, (100 - n) / (n / elapsed * 3600)))
    assert {tuple(r) for r in spark.read.schema(rates.OUTPUT).parquet(sink).collect()} == want and len(want) >= 14


def test_unchanged_redelivery_is_dropped_by_state_and_a_change_passes(spark):
    folder, sink, ckpt = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    rows = spark.sql("select timestamp '2024-01-01' ts, 1L k, h from values ('a'), ('a'), ('b') v(h)")
    rows.coalesce(1).write.mode("overwrite").parquet(folder)
    stream = flows.event_time(flows.landed(spark, folder, rows.schema), "ts", "1 day")
    flows.run_available(flows.without_redelivered(stream, ["k"], "h"), sink, ckpt)
    assert sorted(r.h for r in spark.read.parquet(sink).collect()) == ["a", "b"]
