"""Streaming queries: each drives a flow over the landed files and returns its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.operators import scoring
from raresift.plans.audit_queries import acquired
from raresift.plans.locus_queries import LOCI, SCHEMA, UNION_SQL
from raresift.plans.model_queries import _OFFERS_SQL, LINEAR, POOL
from raresift.plans.registry import query
from raresift.plans.tile_queries import scratch
from raresift.session import release, settle, shuffles_deleted
from raresift.streaming import flows, rates, stale


ROWS_A_FILE = 500_000


def _land(t, df, name, of, batches=3):
    """Land ``df`` in files of bounded size, as table ``of`` has at least its rows; returns the folder and the files of a batch.

    The rows are written first and then dealt a batch at a time, by their place in the written files, so that the shuffle of all rows
    never lies on disk at once, nor beside the shuffles that made them.
    """
    folder = scratch(t, name)
    each = max(1, -(-of.count() // (ROWS_A_FILE * batches)))  # counted from file footers
    rows = settle(df)
    with shuffles_deleted(t.spark):
        for batch in range(batches):
            mine = rows.where(F.col("_metadata.row_index") % batches == batch) if batches > 1 else rows
            mine.repartition(each).write.mode("append").option("compression", "zstd").parquet(folder)
    release(rows)
    return folder, each


@query(
    "str_01_annotate_stream",
    f"""with {UNION_SQL} select compatible_variant_mask, count(*) n, cast(sum(source_id) as bigint) ids from u group by 1""",
)
def str_01(t):
    pool = t.landed_pool()
    (folder, each), sink = _land(t, pool, "land", t.lineitem), scratch(t, "sink")
    stream = flows.landed(t.spark, folder, pool.schema, files_per_trigger=each)
    annotated = flows.annotate(stream, LOCI, SCHEMA).select("source_id", "compatible_variant_mask")
    flows.run_available(annotated, sink, scratch(t, "ckpt"))
    return t.spark.read.parquet(sink).groupBy("compatible_variant_mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids")
    )


@query("str_02_redelivery", "select event_id, tile_id, status from v_tilelog")
def str_02(t):
    log = t.tilelog.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch(t, "land")
    for _ in range(2):  # every row arrives twice, in files that fall into different batches
        log.repartition(2).write.mode("append").parquet(folder)
    sink = scratch(t, "sink")
    stream = flows.landed(t.spark, folder, log.schema, files_per_trigger=1).withColumn("checksum", F.md5("status"))
    flows.append_once(stream, ["event_id"], "checksum", sink, scratch(t, "ckpt"))
    return t.spark.read.parquet(sink).select("event_id", "tile_id", "status")


@query("str_03_exclude_stream", "select source_id, G from v_core where source_id not in (select source_id from v_known)")
def str_03(t):
    core = t.core.select("source_id", "G")
    (folder, each), sink = _land(t, core, "land", t.lineitem), scratch(t, "sink")
    stream = flows.landed(t.spark, folder, core.schema, files_per_trigger=each)
    flows.run_available(flows.exclude_static(stream, t.known), sink, scratch(t, "ckpt"))
    return t.spark.read.schema(core.schema).parquet(sink)


def _events(t):
    stream = flows.landed(t.spark, t.sf_dir, t.events.schema, glob="events.parquet")
    tile = F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string"))
    return flows.event_time(stream.withColumn("tile_id", tile), "ts", "1 hour")


@query(
    "str_04_progress_windows",
    """with w as (select time_bucket(interval '6 hours', ts) ws, event_type, count(*) n, round(sum(value), 4) bytes from events group by 1, 2)
    select strftime(ws, '%Y-%m-%d %H:%M:%S') window_start, event_type, n, bytes from w
    where ws + interval '6 hours' <= (select max(ts) - interval '1 hour' from events)""",
)
def str_04(t):
    sink = scratch(t, "sink")
    out = flows.progress(
        _events(t), time="ts", size="6 hours", by=["event_type"],
        measures={"n": F.count(F.lit(1)), "bytes": F.round(F.sum("value"), 4)},
    )
    flows.run_available(out, sink, scratch(t, "ckpt"))
    closed = t.spark.read.parquet(sink)
    return closed.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "bytes")


@query(
    "str_04_sliding_windows",
    """with s as (select unnest([0, 3]) k), w as (select time_bucket(interval '6 hours', ts - to_hours(k)) + to_hours(k) ws, count(*) n
      from events, s group by 1)
    select strftime(ws, '%Y-%m-%d %H:%M:%S') window_start, n from w
    where ws + interval '6 hours' <= (select max(ts) - interval '1 hour' from events)""",
)
def str_04_sliding(t):
    sink = scratch(t, "sink")
    out = flows.progress(_events(t), time="ts", size="6 hours", slide="3 hours", measures={"n": F.count(F.lit(1))})
    flows.run_available(out, sink, scratch(t, "ckpt"))
    return t.spark.read.parquet(sink).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n"
    )


@query(
    "str_04_rate_and_eta",
    """with d as (select concat('b', cast(cast(substr(tile_id, 2) as int) % 4 as string)) build, epoch_us(ts) // 1000 ms, event_id
      from v_tilelog where status = 'completed'),
    p as (select build, ms, row_number() over (partition by build order by ms, event_id) handled, min(ms) over (partition by build) f from d
      where ms <= (select epoch_us(max(ts) - interval '1 hour') // 1000 from events)),
    e as (select build, handled, ms at_ms, (ms - f) / 1e3 elapsed_s, handled / nullif((ms - f) / 1e3, 0) * 36e2 rate from p where handled % 50 = 0)
    select build, handled, at_ms, elapsed_s, round(rate, 6) tiles_per_hour, round((3000 - handled) / rate, 6) eta_hours from e""",
)
def str_04_rates(t):
    """Ends come out of order within files and are counted in the order of time, once the watermark has passed them."""
    log = t.tilelog.withColumn("ts", F.col("ts").cast("timestamp")).drop("bytes")
    folder, sink = scratch(t, "land"), scratch(t, "sink")
    log.repartitionByRange(5, "ts").sortWithinPartitions(F.xxhash64("event_id")).write.parquet(folder)
    stream = flows.event_time(flows.landed(t.spark, folder, log.schema, files_per_trigger=5), "ts", "1 hour")
    build = F.concat(F.lit("b"), (F.substring("tile_id", 2, 9).cast("int") % 4).cast("string"))
    ends = stream.withColumns({"build": build, "ms": F.unix_millis("ts")}).where("status = 'completed'")
    with stale.rocksdb_state(t.spark):
        flows.run_available(rates.build_rates(ends, every=50, expected=3000), sink, scratch(t, "ckpt"))
    found = t.spark.read.schema(rates.OUTPUT).parquet(sink)
    return found.withColumns({c: F.round(c, 6) for c in ("tiles_per_hour", "eta_hours")})


@query(
    "str_05_stale_sessions",
    """with g as (select concat('t', cast(user_id % 40 as string)) tile_id, ts, ts - lag(ts) over (partition by user_id % 40 order by ts) gap
        from events),
    k as (select tile_id, ts, sum(case when gap is null or gap >= interval '2 hours' then 1 else 0 end) over (partition by tile_id order by ts
        rows unbounded preceding) sid from g),
    s as (select tile_id, sid, min(ts) a, max(ts) + interval '2 hours' b, count(*) n from k group by tile_id, sid)
    select tile_id, strftime(a, '%Y-%m-%d %H:%M:%S') session_start, n n_updates from s where b <= (select max(ts) - interval '1 hour' from events)""",
)
def str_05(t):
    sink = scratch(t, "sink")
    flows.run_available(flows.quiet_sessions(_events(t), time="ts", gap="2 hours", key="tile_id"), sink, scratch(t, "ckpt"))
    return t.spark.read.parquet(sink).select(
        "tile_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_updates"
    )


@query(
    "str_05_stale_timers",
    """with st as (select tile_id, ts, status from (select *, row_number() over (partition by tile_id order by epoch_us(ts) // 1000 desc, event_id desc) rn
      from v_tilelog) where rn = 1)
    select tile_id, epoch_us(ts) // 1000 updated_at_ms, 'failed' status from st where status = 'running'
      and ts + interval '30 minutes' <= (select max(ts) - interval '1 hour' from events)""",
)
def str_05_timers(t):
    log = t.tilelog.withColumn("ts", F.col("ts").cast("timestamp")).drop("bytes")
    (folder, each), sink = _land(t, log, "land", t.events, batches=1), scratch(t, "sink")
    stream = flows.event_time(flows.landed(t.spark, folder, log.schema, files_per_trigger=each), "ts", "1 hour").withColumn("ms", F.unix_millis("ts"))
    with stale.rocksdb_state(t.spark):
        flows.run_available(stale.stale_tiles(stream, quiet_minutes=30), sink, scratch(t, "ckpt"))
    return t.spark.read.schema(stale.OUTPUT).parquet(sink)


@query(
    "str_06_score_stream",
    f"with {_OFFERS_SQL} select result_id, count(*) rows_scored, count(*) filter (where raw >= threshold) rows_positive from offers where raw is not null group by 1",
)
def str_06(t):
    pool = t.sql(POOL)
    (folder, each), sink = _land(t, pool, "land", t.lineitem), scratch(t, "sink")
    stream = flows.landed(t.spark, folder, pool.schema, files_per_trigger=each)
    scored = scoring.score_rows(scoring.eligible_rows(stream, LINEAR))
    running = scored.groupBy("result_id").agg(
        F.count(F.lit(1)).alias("rows_scored"), F.sum(F.col("predicted").cast("long")).alias("rows_positive")
    )
    flows.run_batches(running, flows.latest_counts(sink), scratch(t, "ckpt"), mode="update")
    history = t.spark.read.parquet(sink)
    return history.groupBy("result_id").agg(
        F.max_by("rows_scored", "batch_id").alias("rows_scored"), F.max_by("rows_positive", "batch_id").alias("rows_positive")
    )
