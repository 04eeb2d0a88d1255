"""Exact ranks and running totals over orders too large for one task.

A plain ``row_number() over (order by ...)`` sends a whole group to one task.
Here rows are range-partitioned on (group, order), every partition is scanned
on its own, and the totals of the earlier partitions are added as offsets. The
offset table has at most one row per (partition, group).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from raresift.session import cut_lineage

_PID = "__part"


def running_totals(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    order: Sequence[Column],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``totals`` along ``order`` within ``by``.

    ``order`` must be total within a group (end it with an id), otherwise equal
    rows share a partition and their mutual order is arbitrary.
    """
    by = list(by)
    keyed = df.withColumns({f"__in_{name}": value for name, value in totals.items()})
    ranged = cut_lineage(
        keyed.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(_PID, F.spark_partition_id())
    )
    local = W.partitionBy(_PID, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    scanned = ranged.withColumns({name: F.sum(f"__in_{name}").over(local) for name in totals})
    earlier = W.partitionBy(*by).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(_PID, *by)
        .agg(*[F.sum(f"__in_{name}").alias(f"__sum_{name}") for name in totals])
        .select(
            F.col(_PID).alias("__opart"),
            *[F.col(c).alias(f"__o_{c}") for c in by],
            *[F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__off_{name}") for name in totals],
        )
    )
    same = F.col(_PID) == F.col("__opart")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return scanned.join(offsets, same, "left").select(
        *df.columns, *[(F.col(name) + F.col(f"__off_{name}")).alias(name) for name in totals]
    )


def global_rank(
    df: DataFrame, *, by: Sequence[str] = (), order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based contiguous rank along a total ``order``, per group, without a single-task window."""
    return running_totals(df, by=by, order=order, totals={name: F.lit(1).cast("long")})


def average_rank(df: DataFrame, value: str, *, by: Sequence[str] = (), name: str = "avg_rank",
                 descending: bool = False) -> DataFrame:
    """Average (tie-sharing) rank of ``value``; NULL values keep a NULL rank.

    Ties are folded to one row per distinct value before anything is ordered,
    so a value shared by a third of the rows costs one counter.
    """
    by = list(by)
    peers = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__peers"))
    )
    key = F.col(value).desc() if descending else F.col(value).asc()
    ranked = running_totals(peers, by=by, order=[key], totals={"__upto": F.col("__peers")}).select(
        *[F.col(c).alias(f"__r_{c}") for c in by],
        F.col(value).alias("__r_value"),
        (F.col("__upto") - (F.col("__peers") - 1) / F.lit(2.0)).alias(name),
    )
    same = F.col(value) == F.col("__r_value")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return df.join(ranked, same, "left").select(*df.columns, name)


def percentile_ranks(df: DataFrame, key: str, metrics: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Average rank over the non-NULL count of several columns at once; NULL values get 0.

    ``metrics`` maps the output name to (column, descending). All columns are
    stacked into one long frame, so there is one ordered scan for all of them.
    """
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("metric"),
            (-F.col(column) if descending else F.col(column)).cast("double").alias("value"),
        )
        for name, (column, descending) in metrics.items()
    ])
    long = df.select(key, F.inline(rows)).where(F.col("value").isNotNull())
    ranked = average_rank(long, "value", by=["metric"], name="__rank")
    sizes = long.groupBy("metric").agg(F.count(F.lit(1)).alias("__size"))
    wide = (
        ranked.join(sizes, "metric")
        .groupBy(key)
        .pivot("metric", list(metrics))
        .agg(F.max(F.col("__rank") / F.col("__size")))
    )
    return df.join(wide, key, "left").withColumns({name: F.coalesce(F.col(name), F.lit(0.0)) for name in metrics})
