"""Comparing populations and binning them, without gathering a population in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from raresift.operators.ordered import running_totals
from raresift.operators.quantiles import exact_quantiles


def two_sample_distances(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein-1 distance per column.

    Both samples are folded to counts per (column, value); the two cumulative
    counts come from one range-partitioned scan. Each value's gap to its
    successor is looked up by position.
    """
    def long(df: DataFrame, tag: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        return df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn(
            "in_a", F.lit(1 if tag == "a" else 0).cast("long")
        )

    counts = long(a, "a").unionByName(long(b, "b")).groupBy("column", "value").agg(
        F.sum("in_a").alias("na"), F.sum(1 - F.col("in_a")).alias("nb")
    )
    placed = running_totals(
        counts,
        by=["column"],
        order=[F.asc("value")],
        totals={"ca": F.col("na"), "cb": F.col("nb"), "place": F.lit(1).cast("long")},
    )
    sizes = placed.groupBy("column").agg(F.max("ca").alias("size_a"), F.max("cb").alias("size_b"))
    following = placed.select("column", (F.col("place") - 1).alias("place"), F.col("value").alias("next_value"))
    joined = placed.join(following, ["column", "place"], "left").join(sizes, "column")
    gap = F.abs(F.try_divide("ca", "size_a") - F.try_divide("cb", "size_b"))
    return joined.groupBy("column").agg(
        F.max("size_a").alias("n_a"),
        F.max("size_b").alias("n_b"),
        F.round(F.max(gap), 6).alias("ks_statistic"),
        F.round(F.sum(gap * (F.col("next_value") - F.col("value"))), 6).alias("wasserstein"),
    )


def moments(df: DataFrame, columns: Sequence[str], *, tag: str) -> DataFrame:
    """n, mean and sample deviation of each column in one aggregate, as rows."""
    wide = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    )
    return wide.select(
        F.lit(tag).alias("pool"),
        F.inline(F.array(*[
            F.struct(
                F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"),
                F.col(f"s_{c}").alias("std"),
            )
            for c in columns
        ])),
    )


def equal_width_histogram(df: DataFrame, value: str, *, low: float, high: float, bins: int, by: Sequence[str] = ()):
    """Counts per bin, the last bin closed on the right."""
    width = (high - low) / bins
    index = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("long"))
    inside = df.where(F.col(value).between(low, high))
    return inside.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def density_grid(df: DataFrame, x: str, y: str, *, bins: tuple[int, int], pad: float = 0.03,
                 probs: tuple[float, float] = (0.002, 0.998), fixed=None) -> DataFrame:
    """Non-empty cells of a 2-D histogram over the padded central range, with a log opacity."""
    finite = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(x, y)
    ranges = []
    for i, c in enumerate((x, y)):
        if fixed is not None:
            low, high = fixed[i]
        else:
            row = exact_quantiles(finite, c, probs, names=["lo", "hi"]).first()
            low, high = row["lo"], row["hi"]
            if abs(low - high) < 1e-12:
                low, high = low - 0.5, high + 0.5
            span = (high - low) * pad
            low, high = low - span, high + span
        ranges.append((low, high))
    (x0, x1), (y0, y1) = ranges
    wx, wy = (x1 - x0) / bins[0], (y1 - y0) / bins[1]
    cells = (
        finite.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
        .groupBy(
            F.least(F.floor((F.col(x) - x0) / wx), F.lit(bins[0] - 1).cast("long")).alias("xi"),
            F.least(F.floor((F.col(y) - y0) / wy), F.lit(bins[1] - 1).cast("long")).alias("yi"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )
    top = cells.agg(F.max(F.log1p(F.col("count"))).alias("__top"))
    return cells.join(F.broadcast(top)).select(  # one row
        "xi", "yi", "count", (0.05 + 0.20 * F.log1p(F.col("count")) / F.greatest("__top", F.lit(1e-9))).alias("opacity")
    )
