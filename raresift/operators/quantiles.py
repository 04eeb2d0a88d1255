"""Exact quantiles and robust statistics for columns of any length.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer. Here a sketch narrows each quantile to a bracket first, and only the
values inside the brackets are counted and accumulated over range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raresift.operators.ordered import percentile_ranks, running_totals
from raresift.session import cut_lineage


_ACCURACY = 10_000  # rank error of the sketch is at most n / _ACCURACY
_SLACKS = [3.0 / _ACCURACY, 30.0 / _ACCURACY, 300.0 / _ACCURACY, 3000.0 / _ACCURACY]


def _same_group(left: str, right: str, by: Sequence[str]) -> Column:
    rule = F.lit(True)
    for c in by:
        rule = rule & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return rule


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], *, by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per probability. NULL and NaN are left out.

    A mergeable sketch first brackets every quantile between two data values.
    The bracket must be wide enough for the sketch's rank error and for the two
    neighbours between which a quantile is interpolated; the narrowest of a
    ladder of widths that is gets taken, or the whole range. The second pass
    counts what lies below a bracket and keeps distinct values only inside it,
    so few rows of a large group are shuffled, and the exact neighbours are read
    off the accumulated counts. A neighbour outside its bracket is an error.
    """
    by = list(by)
    names = list(names or [f"p{round(p * 1000):03d}" for p in probs])
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("__v"))
    cuts = [c for p in probs for slack in _SLACKS for c in (max(p - slack, 0.0), min(p + slack, 1.0))]
    stats = clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__total"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", cuts, _ACCURACY).alias("__cuts"),
    )
    needed = 2.0 / F.col("__total") + 2.0 / _ACCURACY
    bracket = []
    for i, p in enumerate(probs):
        low, high = F.col("__min"), F.col("__max")
        for j, slack in reversed(list(enumerate(_SLACKS))):
            at = 2 * (i * len(_SLACKS) + j)
            if p - slack > 0:
                low = F.when(needed <= slack, F.get("__cuts", F.lit(at))).otherwise(low)
            else:
                low = F.when(needed <= slack, F.col("__min")).otherwise(low)
            if p + slack < 1:
                high = F.when(needed <= slack, F.get("__cuts", F.lit(at + 1))).otherwise(high)
            else:
                high = F.when(needed <= slack, F.col("__max")).otherwise(high)
        bracket.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")))
    small = cut_lineage(stats.select(*by, "__total", F.array(*bracket).alias("__brackets")))
    joined = (
        clean.alias("v").join(small.alias("s"), _same_group("v", "s", by)).select("v.*", "__total", "__brackets")
        if by
        else clean.join(F.broadcast(small))  # one row
    )
    # NULL stands for "below the bracket" and sorts first.
    counts = (
        joined.select(*by, "__total", "__v", F.explode("__brackets").alias("b"))
        .where(F.col("__v") <= F.col("b.high"))
        .groupBy(*by, "__total", F.col("b.i").alias("__i"), F.when(F.col("__v") >= F.col("b.low"), F.col("__v")).alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    placed = running_totals(
        counts, by=[*by, "__i"], order=[F.asc_nulls_first("__x")], totals={"__upto": F.col("__n")}
    )
    first = F.col("__upto") - F.col("__n")
    picks = []
    for i, (name, p) in enumerate(zip(names, probs)):
        position = F.lit(float(p)) * (F.col("__total") - 1)

        def at(index: Column) -> Column:
            found = F.max(F.when((F.col("__i") == i) & (index >= first) & (index < F.col("__upto")), F.col("__x")))
            return F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

        picks += [
            at(F.floor(position)).alias(f"__lo_{name}"),
            at(F.ceil(position)).alias(f"__hi_{name}"),
            F.max(position - F.floor(position)).alias(f"__f_{name}"),
        ]
    found = placed.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n)
            for n in names
        ],
    )


def _attach(df: DataFrame, extra: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(extra, list(by)) if by else df.join(F.broadcast(extra))  # one row without groups


def mad_sigma(df: DataFrame, value: str, *, by: Sequence[str] = (), name: str = "sigma_mad") -> DataFrame:
    """1.4826 times the median absolute deviation; the population deviation where that is 0."""
    by = list(by)
    middle = exact_quantiles(df, value, [0.5], by=by, names=["__median"])
    spread = _attach(df.select(*by, value), middle, by).withColumn("__dev", F.abs(F.col(value) - F.col("__median")))
    mad = exact_quantiles(spread, "__dev", [0.5], by=by, names=["__mad"])
    plain = df.groupBy(*by).agg(F.stddev_pop(value).alias("__std"))
    both = _attach(mad, plain, by)
    return both.select(
        *by, F.when(F.col("__mad") > 0, 1.4826 * F.col("__mad")).otherwise(F.col("__std")).alias(name)
    )


def spearman_pairs(df: DataFrame, pairs: dict[str, tuple[str, str]], *, key: str = "source_id") -> DataFrame:
    """Rank correlations of several column pairs with average ranks, in one ordered scan.

    ``df`` must be free of NULLs in the columns used.
    """
    columns = sorted({c for pair in pairs.values() for c in pair})
    ranked = percentile_ranks(df, key, {f"__r_{c}": (c, False) for c in columns})
    return ranked.agg(*[F.corr(f"__r_{a}", f"__r_{b}").alias(name) for name, (a, b) in pairs.items()])
