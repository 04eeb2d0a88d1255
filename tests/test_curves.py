import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import curves, distributions
from raresift.operators.quantiles import exact_quantiles, mad_sigma


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(
        [("m", 1, 0.9, 1), ("m", 2, 0.8, 0), ("m", 3, 0.7, 1), ("m", 4, 0.6, 0)],
        "result_id string, source_id long, score double, target int",
    )


def test_pr_and_roc_points(four):
    steps = curves.score_steps(four, ["result_id"])
    pr = curves.pr_points(steps, ["result_id"]).orderBy("point").collect()
    assert [r.recall for r in pr] == [0, 0.5, 0.5, 1, 1]
    assert [r.precision for r in pr] == pytest.approx([1, 1, 0.5, 2 / 3, 0.5])
    roc = curves.roc_points(steps, ["result_id"]).orderBy("fpr", "tpr").collect()
    assert [(r.fpr, r.tpr) for r in roc] == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]


def test_tied_scores_make_one_point(spark):
    df = spark.createDataFrame([("m", i, 0.5, i % 2) for i in range(10)], "result_id string, source_id long, score double, target int")
    steps = curves.score_steps(df, ["result_id"])
    assert steps.count() == 1
    row = curves.area_metrics(steps, ["result_id"]).first()
    assert (row.average_precision, row.roc_auc) == (0.5, 0.5)


def test_one_class_gives_no_curve(spark):
    df = spark.createDataFrame([("m", 1, 0.5, 1)], "result_id string, source_id long, score double, target int")
    assert curves.score_steps(df, ["result_id"]).count() == 0


def test_operating_point(four):
    row = curves.operating_point(four, ["result_id"], F.lit(0.8)).first()
    assert (row.recall, row.precision, row.fpr, row.tpr) == (0.5, 0.5, 0.5, 0.5)


def test_budget_metrics(spark):
    df = spark.createDataFrame(
        [("m", 1, 0.9, 1), ("m", 2, 0.8, 0), ("m", 3, 0.7, 1), ("m", 4, 0.1, 0)],
        "result_id string, source_id long, score double, target int",
    )
    got = {r.k: r for r in curves.budget_metrics(df, ["result_id"], [1, 3]).collect()}
    assert got[1].precision_at_k == 1.0
    assert (got[3].recall_at_k, got[3].hits, got[3].candidates_per_hit) == (1.0, 2, 1.5)


def test_fpr_without_room_has_infinite_threshold(spark):
    df = spark.createDataFrame([("m", 1, 0.9, 0), ("m", 2, 0.8, 1)], "result_id string, source_id long, score double, target int")
    row = curves.recall_at_fpr(curves.score_steps(df, ["result_id"]), ["result_id"], [0.01]).first()
    assert row.recall == 0.0 and math.isinf(row.threshold)


def test_downsample_keeps_both_ends(spark):
    df = spark.createDataFrame([("m", i, i / 1000, int(i % 3 == 0)) for i in range(500)], "result_id string, source_id long, score double, target int")
    curve = curves.pr_points(curves.score_steps(df, ["result_id"]), ["result_id"])
    points = sorted(r.point for r in curves.downsample(curve, ["result_id"], 40).collect())
    assert len(points) <= 40 and points[0] == 0 and points[-1] == 500


def test_quantiles_match_numpy_with_a_dominant_value(spark):
    rng = np.random.default_rng(0)
    values = np.r_[np.full(700, 2.5), rng.normal(size=1300)]
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, g int")
    got = exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.975, 1.0]).first()
    assert list(got) == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.975, 1.0]))
    sigma = {r.g: r.sigma_mad for r in mad_sigma(df, "v", by=["g"]).collect()}
    for g in (0, 1):
        part = values[g::2]
        assert sigma[g] == pytest.approx(1.4826 * np.median(np.abs(part - np.median(part))))


@pytest.mark.parametrize("kind", ["smooth", "hot"])
def test_quantiles_of_long_columns_are_exact(spark, kind):
    """Long enough for the sketched brackets, with one value holding a third of the rows."""
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.rand(3)).alias("hot"), F.rand(7).alias("smooth")
    ).select(F.col(kind).alias("v"), (F.rand(1) < 0.1).alias("g"))
    rows = spark.createDataFrame(rows.toPandas()).cache()
    probs = [0.0, 0.001, 0.25, 0.4, 0.5, 0.975, 1.0]
    local = rows.toPandas()
    assert list(exact_quantiles(rows, "v", probs).first()) == pytest.approx(np.quantile(local["v"], probs), abs=1e-15)
    for r in exact_quantiles(rows, "v", probs, by=["g"]).collect():
        assert list(r)[1:] == pytest.approx(np.quantile(local[local.g == r.g]["v"], probs), abs=1e-15)


def test_zero_mad_falls_back_to_the_deviation(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "v double")
    assert mad_sigma(df, "v").first()[0] == pytest.approx(np.std([1, 1, 1, 5]))


def test_distances_match_direct_formulas(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400).round(2), rng.normal(0.3, 1.2, size=150).round(2)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    got = distributions.two_sample_distances(frame(a), frame(b), ["v"]).first()
    grid = np.unique(np.r_[a, b])
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert got.ks_statistic == pytest.approx(np.abs(fa - fb).max(), abs=1e-6)
    assert got.wasserstein == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum(), abs=1e-6)
