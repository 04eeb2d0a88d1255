"""Exact precision-recall and ROC curves, thresholds and ranking metrics.

Everything starts from one row per distinct score (a map-side combined
aggregate), whose running totals replace the per-threshold rescans of a naive
implementation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raresift.operators.ordered import running_totals
from raresift.operators.ranking import top_per_group
from raresift.session import cut_lineage



def _class_totals(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    return pred.groupBy(*by).agg(
        F.count_if(F.col("target") == 1).alias("positives"),
        F.count_if(F.col("target") == 0).alias("negatives"),
    )


def _counted(rule: Column, count: str | None) -> Column:
    return F.count_if(rule) if count is None else F.sum(F.when(rule, F.col(count)).otherwise(F.lit(0).cast("long")))


def score_steps(pred: DataFrame, by: Sequence[str], *, count: str | None = None) -> DataFrame:
    """One row per (group, distinct score) with own and running class counts; a row stands for ``count`` equal ones.

    Rows without score or target are dropped, and so are groups with one class.
    """
    by = list(by)
    scored = pred.where(F.col("score").isNotNull() & F.col("target").isNotNull())
    # Written, as the ranges, the running sums and the totals each read it.
    distinct = cut_lineage(scored.groupBy(*by, "score").agg(
        _counted(F.col("target") == 1, count).alias("pos"), _counted(F.col("target") == 0, count).alias("neg")
    ))
    steps = running_totals(
        distinct,
        by=by,
        order=[F.desc("score")],
        totals={"tp": F.col("pos"), "fp": F.col("neg"), "step": F.lit(1).cast("long")},
    )
    totals = distinct.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.count(F.lit(1)).alias("steps")
    ).where("positives > 0 and negatives > 0")
    return steps.join(totals, by)


def pr_points(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """PR curve from (recall 0, precision 1) to full recall."""
    by = list(by)
    curve = steps.select(
        *by,
        F.col("step").alias("point"),
        (F.col("tp") / F.col("positives")).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        "score",
        "steps",
    )
    ends = steps.where("step = 1").select(
        *by,
        F.lit(0).cast("long").alias("point"),
        F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"),
        F.lit(None).cast("double").alias("score"),
        "steps",
    )
    return curve.unionByName(ends)


def roc_points(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC curve from (0, 0); interior points on a straight segment are dropped.

    A point lies on a straight segment when the next distinct score adds the
    same class counts, so only the following step is looked up.
    """
    by = list(by)
    following = steps.select(
        *by, (F.col("step") - 1).alias("step"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
    )
    bend = (
        (F.col("step") == 1)
        | (F.col("step") == F.col("steps"))
        | (F.col("pos") != F.col("next_pos"))
        | (F.col("neg") != F.col("next_neg"))
    )
    curve = steps.join(following, [*by, "step"], "left").where(bend).select(
        *by,
        (F.col("fp") / F.col("negatives")).alias("fpr"),
        (F.col("tp") / F.col("positives")).alias("tpr"),
        "score",
    )
    start = steps.where("step = 1").select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("score")
    )
    return curve.unionByName(start)


def downsample(curve: DataFrame, by: Sequence[str], max_points: int) -> DataFrame:
    """Keep at most ``max_points`` rows per curve at evenly spaced positions.

    ``curve`` carries a 0-based ``point`` and the last position ``steps``.
    """
    by = list(by)
    lengths = curve.where("point = 0").select(*by, F.col("steps").alias("last"))
    slots = lengths.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max_points - 1))))
    picked = slots.select(
        *by,
        F.when(F.col("slot") == max_points - 1, F.col("last"))
        .otherwise(F.floor(F.col("slot") * (F.col("last") / F.lit(max_points - 1.0))))
        .alias("point"),
    ).distinct()
    short = curve.where(F.col("steps") < max_points)
    long = curve.where(F.col("steps") >= max_points).join(picked, [*by, "point"], "left_semi")
    return short.unionByName(long)


def area_metrics(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average precision and trapezoid ROC area, ties shared."""
    recall_gain = F.col("pos") / F.col("positives")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    strip = F.col("neg") / F.col("negatives") * (F.col("tp") - F.col("pos") / 2.0) / F.col("positives")
    return steps.groupBy(*by).agg(
        F.round(F.sum(recall_gain * precision), 6).alias("average_precision"),
        F.round(F.sum(strip), 6).alias("roc_auc"),
    )


def operating_point(pred: DataFrame, by: Sequence[str], threshold: Column) -> DataFrame:
    """Exact recall, precision and FPR at one threshold, in one aggregate."""
    hit = F.col("score") >= threshold
    counts = pred.where(F.col("score").isNotNull() & F.col("target").isNotNull()).groupBy(*by).agg(
        F.count_if(hit & (F.col("target") == 1)).alias("tp"),
        F.count_if(hit & (F.col("target") == 0)).alias("fp"),
        F.count_if(F.col("target") == 1).alias("positives"),
        F.count_if(F.col("target") == 0).alias("negatives"),
        F.max(threshold).alias("score"),
    )
    recall = F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0))
    return counts.where("positives > 0 and negatives > 0").select(
        *by,
        recall.alias("recall"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("fp", "negatives"), F.lit(0.0)).alias("fpr"),
        recall.alias("tpr"),
        "score",
    )


def budget_metrics(pred: DataFrame, by: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Hits, precision, recall and cost of the first k rows, long by k."""
    by = list(by)
    top = top_per_group(
        pred, by=by, order=[F.desc("score"), F.asc("source_id")], limit=max(ks), rank="rank"
    )
    hits = top.groupBy(*by).agg(
        *[F.count_if((F.col("rank") <= k) & (F.col("target") == 1)).alias(f"hits_{k}") for k in ks],
        *[F.count_if(F.col("rank") <= k).alias(f"size_{k}") for k in ks],
    )
    rows = F.array(*[
        F.struct(F.lit(k).cast("long").alias("k"), F.col(f"hits_{k}").alias("hits"), F.col(f"size_{k}").alias("size"))
        for k in ks
    ])
    return hits.join(_class_totals(pred, by), by).select(*by, "positives", F.inline(rows)).select(
        *by,
        "k",
        "hits",
        F.coalesce(F.try_divide("hits", "size"), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.try_divide("hits", "positives"), F.lit(0.0)).alias("recall_at_k"),
        F.try_divide("size", "hits").alias("candidates_per_hit"),
    )


def recall_at_fpr(steps: DataFrame, by: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Highest recall whose false positives stay within floor(level * negatives)."""
    spread = steps.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    within = F.col("fp") <= F.floor(F.col("level") * F.col("negatives"))
    return spread.groupBy(*by, "level").agg(
        F.coalesce(F.max(F.when(within, F.col("tp") / F.col("positives"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.min(F.when(within, F.col("score"))), F.lit(float("inf"))).alias("threshold"),
    )


def threshold_table(steps: DataFrame, *, beta: float = 2.0) -> DataFrame:
    """Metrics of every distinct threshold from its running counts."""
    b2 = float(beta) ** 2
    p, r = F.col("precision"), F.col("recall")
    tn = F.col("negatives") - F.col("fp")
    return (
        steps.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
        .withColumn("recall", F.col("tp") / F.col("positives"))
        .withColumn("f_beta", F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0)))
        .withColumn("accuracy", (F.col("tp") + tn) / (F.col("positives") + F.col("negatives")))
        .withColumn("balanced_accuracy", (r + tn / F.col("negatives")) / 2.0)
    )


def select_threshold(
    steps: DataFrame,
    by: Sequence[str],
    *,
    beta: float = 2.0,
    min_precision: float = 0.5,
    min_accuracy: float = 0.0,
    min_balanced_accuracy: float = 0.0,
) -> DataFrame:
    """Best threshold by F-beta under floors, with two fallback orders.

    Each tier is a conditional ``max(struct)``, so a model with very many
    distinct scores is still reduced on the map side.
    """
    fields = ["threshold", "precision", "recall", "f_beta", "accuracy", "balanced_accuracy"]
    table = threshold_table(steps, beta=beta).withColumn("threshold", F.col("score"))
    lowest = (-F.col("score")).alias("low")
    payload = F.struct(*fields).alias("row")
    floors = (F.col("accuracy") >= min_accuracy) & (F.col("balanced_accuracy") >= min_balanced_accuracy)
    tiers = [
        F.max(F.when(floors & (F.col("precision") >= min_precision),
                     F.struct("f_beta", "recall", "precision", lowest, payload))).alias("t1"),
        F.max(F.when(floors, F.struct("precision", "f_beta", "recall", lowest, payload))).alias("t2"),
        F.max(F.struct("precision", "accuracy", "balanced_accuracy", "f_beta", lowest, payload)).alias("t3"),
    ]
    best = table.groupBy(*by).agg(*tiers).select(
        *by, F.coalesce(F.col("t1.row"), F.col("t2.row"), F.col("t3.row")).alias("row")
    )
    return best.select(*by, "row.*").withColumns(
        {
            "precision_floor_met": F.col("precision") >= min_precision,
            "accuracy_floor_met": F.col("accuracy") >= min_accuracy,
            "balanced_accuracy_floor_met": F.col("balanced_accuracy") >= min_balanced_accuracy,
        }
    )


def confusion(pred: DataFrame, by: Sequence[str], *, count: str | None = None) -> DataFrame:
    """TP/FP/FN/TN and derived rates; a zero denominator gives 0. NULL ``predicted`` counts as 0. A row stands for ``count`` equal ones."""
    hit = F.coalesce(F.col("predicted"), F.lit(0)) == 1
    positive = F.col("target") == 1
    counts = pred.groupBy(*by).agg(
        _counted(positive & hit, count).alias("tp"),
        _counted(~positive & hit, count).alias("fp"),
        _counted(positive & ~hit, count).alias("fn"),
        _counted(~positive & ~hit, count).alias("tn"),
    )
    zero = F.lit(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return counts.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": recall,
            "f2": F.coalesce(F.try_divide(5 * tp, 5 * tp + 4 * fn + fp), zero),
            "balanced_accuracy": (recall + F.coalesce(F.try_divide(tn, tn + fp), zero)) / 2.0,
            "accuracy": F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero),
        }
    )


def case_states(ranked: DataFrame, *, basis: str = "review_budget", top_k: int = 100) -> DataFrame:
    """Four diagnostic states by review budget or by operating threshold."""
    positive = F.coalesce(F.col("target"), F.lit(0)) == 1
    # State labels.
    if basis == "review_budget":
        chosen = F.col("rank") <= top_k
        labels = ("WR recovered @K", "Contaminant @K", "WR outside @K", "Background")
    elif basis == "operating_threshold":
        if "predicted" in ranked.columns:
            chosen = F.coalesce(F.col("predicted"), F.lit(0)) == 1
        else:
            chosen = F.col("score") >= F.col("threshold")
        labels = ("True positive", "False positive", "False negative", "True negative")
    else:
        raise ValueError(f"unknown basis: {basis}")
    state = (
        F.when(positive & chosen, labels[0])
        .when(~positive & chosen, labels[1])
        .when(positive & ~chosen, labels[2])
        .otherwise(labels[3])
    )
    return ranked.withColumns({"diagnostic_state": state, "diagnostic_basis": F.lit(basis)})
