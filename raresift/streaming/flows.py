"""Structured Streaming forms of the resumable tile run.

Every flow reads files as they land, keeps its progress in a checkpoint folder
and can be stopped and resumed. ``run_available`` drives a flow over all files
present and then stops, which is how the batch queries and tests use them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from raresift.operators import locus
from raresift.session import cut_lineage
from raresift.streaming.stale import rocksdb_state


def landed(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_trigger: int = 64, glob: str | None = None) -> DataFrame:
    """Stream of landed Parquet files; a bounded number of files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Zone-less timestamps are cast first: a watermark needs an instant."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_available(stream: DataFrame, sink: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process everything that has landed into a Parquet sink, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    """Process everything that has landed with a per-batch action, then stop."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def annotate(stream: DataFrame, loci: Mapping[str, Sequence[locus.Band]], schema: locus.MaskSchema) -> DataFrame:
    """Stateless: the very projection of the batch job."""
    return locus.evaluate_union(stream, loci, schema)


def without_redelivered(stream: DataFrame, keys: Sequence[str], checksum: str) -> DataFrame:
    """Drop rows delivered again unchanged within the watermark; a changed payload passes on, to be refused later."""
    return stream.dropDuplicatesWithinWatermark([*keys, checksum])


def append_once(
    stream: DataFrame, keys: Sequence[str], checksum: str, sink: str, checkpoint: str, *, time: str | None = None, period: str = "30 days"
) -> None:
    """Append rows of new keys, ignore repeats, fail when a key carries two checksums; process all that has landed, then stop.

    Each key has one entry in the stream's keyed state (its first row, lowest and highest checksum, first and last batch), so the cost
    of a batch depends on its own rows and not on what was written before. A key whose first and last batch are one is new. With
    ``time``, a watermarked event time that redelivered rows repeat, entries of a ``period`` are let go once the watermark has passed
    it; rows that come later are dropped as late. A repeated batch replaces its own folder. Payloads must be orderable (no maps).
    """
    payload = stream.columns
    mark = F.struct(F.col(checksum).alias("of"))
    groups = [F.col(k) for k in keys] + ([F.window(time, period).alias("__period")] if time else [])
    state = stream.withColumn("__now", F.current_timestamp()).groupBy(*groups).agg(
        F.min(F.struct(*payload)).alias("row"), F.min(mark).alias("lo"), F.max(mark).alias("hi"),
        F.min("__now").alias("first"), F.max("__now").alias("last"),  # the time of a batch is the same for all its rows
    )

    def action(batch: DataFrame, batch_id: int) -> None:
        touched = cut_lineage(batch)  # the state is advanced once, by the first action on the batch
        if not touched.where("lo <> hi").isEmpty():
            raise ValueError("one key carries different payloads")
        touched.where(F.col("first") == F.col("last")).select("row.*").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    with rocksdb_state(stream.sparkSession):
        run_batches(state, action, checkpoint, mode="update")


def exclude_static(stream: DataFrame, known: DataFrame, key: str = "source_id") -> DataFrame:
    """Stream rows whose key is not in the static list; Spark sizes the list before broadcasting it."""
    return stream.join(known.select(key).distinct(), key, "left_anti")


def progress(stream: DataFrame, *, time: str, size: str, slide: str | None = None, by: Sequence[str] = (),
             measures: Mapping[str, Column]) -> DataFrame:
    """Windowed progress counters; late rows beyond the watermark are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.groupBy(window.alias("w"), *by).agg(*[m.alias(n) for n, m in measures.items()]).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *measures
    )


def quiet_sessions(stream: DataFrame, *, time: str, gap: str, key: str) -> DataFrame:
    """Bursts of activity per tile, closed by ``gap`` without an update."""
    return stream.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n_updates")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_updates"
    )


def latest_counts(sink: str) -> Callable[[DataFrame, int], None]:
    """Batch action for update mode: keep each batch's counters under its id."""

    def action(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return action
