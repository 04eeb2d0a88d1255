"""Two-stage reviews: what a second check keeps at each review budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _budget_rows(budgets: Sequence[int]):
    return F.array(*[F.lit(int(b)) for b in budgets])


def recovery_curve(ranked: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Positives, negatives and cost within each budget under both orders, in one pass."""
    policies = F.array(
        F.struct(F.lit("First stage").alias("policy"), F.col("rank_before").alias("r")),
        F.struct(F.lit("Pass-first").alias("policy"), F.col("rank_after").alias("r")),
    )
    total = ranked.agg(F.count_if(F.col("target") == 1).alias("all_positives"))
    long = ranked.select("target", F.inline(policies)).where(F.col("r") <= max(budgets))
    spread = long.withColumn("budget", F.explode(_budget_rows(budgets))).where("r <= budget")
    counts = spread.groupBy("policy", "budget").agg(
        F.count_if(F.col("target") == 1).alias("recovered"),
        F.count_if(F.col("target") == 0).alias("negatives_reviewed"),
    )
    return counts.join(F.broadcast(total)).select(  # one row
        "policy", "budget", "recovered",
        F.try_divide("recovered", "all_positives").alias("recovered_pct"),
        "negatives_reviewed",
        F.try_divide("budget", "recovered").alias("candidates_per_hit"),
    )


def tradeoff_curve(ranked: DataFrame, budgets: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Retention of positives and removal of negatives among the first rows."""
    inside = ranked.where(F.col("rank_before") <= max(budgets)).withColumn(
        "input_budget", F.explode(_budget_rows(budgets))
    ).where("rank_before <= input_budget")
    positive, passed = F.col("target") == 1, F.col("passed")
    counts = inside.groupBy("input_budget", *by).agg(
        F.count_if(positive).alias("positives_input"),
        F.count_if(positive & passed).alias("positives_pass"),
        F.count_if(~positive).alias("negatives_input"),
        F.count_if(~positive & passed).alias("negatives_pass"),
    )
    return counts.withColumns(
        {
            "retention": F.try_divide("positives_pass", "positives_input"),
            "negative_removal_rate": 1 - F.try_divide("negatives_pass", "negatives_input"),
        }
    )
