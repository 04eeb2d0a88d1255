"""Importances, boosting by rounds, containment of bands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import containment, importance, locus, training


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(2), []
    for k in range(300):
        target = int(k % 3 == 0)
        out.append((k, target, k % 2, float(rng.normal(2.5 * target)), float(rng.normal())))
    return spark.createDataFrame(out, "source_id long, target int, fold int, good double, noise double")


def test_the_useful_feature_is_named_by_every_kind(spark, rows):
    features = ["good", "noise"]
    for kind, name in (("random_forest", "model"), ("logistic_regression", "coefficient")):
        model = training.sampled_pipeline(kind, features).fit(rows)
        own = {r.feature: (r.kind, r.importance) for r in importance.model_importances(spark, model, features).collect()}
        assert own["good"][0] == name and own["good"][1] > 3 * own["noise"][1] >= 0
        drops = importance.permutation_importance(lambda df: training.scores_of(model, df, *df.columns), rows, features)  # noqa: B023
        found = {r.feature: r for r in drops.collect()}
        assert found["good"].importance > 0.2 > abs(found["noise"].importance) and found["good"].importance_std > 0
    with pytest.raises(ValueError):
        importance.permutation_importance(lambda df: df.withColumn("score", F.lit(0.5)), rows.limit(1), features)


def test_partial_boosting_equals_models_of_that_many_rounds(spark, rows):
    found = {r.rounds: r for r in importance.boosting_rounds(rows, ["good", "noise"], [1, 4], params={"maxDepth": 2}).collect()}
    for n in (1, 4):
        whole = importance.complexity_grid(rows, "boosted_trees", ["good", "noise"], {"maxIter": [n], "maxDepth": [2]}).first()
        assert whole.maxIter == str(n) and found[n].cv_rows == whole.cv_rows == found[n].train_rows == 300
        for c in ("cv_f2", "cv_ap", "train_f2", "train_ap"):
            assert found[n][c] == pytest.approx(whole[c], abs=1e-6)


def test_slacks_are_those_of_a_dense_line():
    wide = [locus.Band("J_H", "H_K", 0.5, 0.0, 1.0)]
    loci = {"inside": [locus.Band("J_H", "H_K", 0.6, 0.1, 0.5)], "outside": [locus.Band("J_H", "H_K", 1.5, 0.3, 0.5)], "equal": wide}
    box = {"J_H": (-2.0, 3.0)}
    x = np.sign(g := np.linspace(-2, 3, 2001)) * np.log1p(np.abs(g))
    for variant, (slack,) in containment.plane_slacks(loci, wide, box).items():
        (band,) = loci[variant]
        assert slack == pytest.approx(1.0 - (np.abs((band.slope - 0.5) * x + band.intercept).max() + band.threshold))
        assert (slack >= -containment.TOLERANCE) == (variant != "outside")
    assert containment.signed_log(-2.0) == pytest.approx(-math.log(3.0))


def test_cells_of_a_grid_share_the_rows_of_a_fold(spark, monkeypatch):
    """Four cells and two folds: the rows are prepared three times, not twelve; what is kept are counted scores, not rows."""
    rng, calls = np.random.default_rng(3), []
    data = [(k, int(rng.random() < 0.4), k % 2, float(rng.normal()), float(rng.normal())) for k in range(60)]
    rows = spark.createDataFrame(data, "source_id long, target int, fold int, a double, b double").coalesce(1)
    plain = training.ResampledClassifier.rows_to_fit
    monkeypatch.setattr(training.ResampledClassifier, "rows_to_fit", lambda self, df: calls.append(1) or plain(self, df))
    found = importance.complexity_grid(rows, "random_forest", ["a", "b"], {"numTrees": [2, 3], "maxDepth": [1, 2]}, parallelism=2).collect()
    assert len(found) == 4 and len(calls) == 3
    model = training.sampled_pipeline("random_forest", ["a", "b"], params={"numTrees": 2, "maxDepth": 1}).fit(rows)
    scored = training.scores_of(model, rows, "target").withColumn("part", F.lit("train"))
    whole = importance._quality(scored, []).first()
    (cell,) = [r for r in found if (r.numTrees, r.maxDepth) == ("2", "1")]
    assert (cell.train_f2, cell.train_ap, cell.train_rows) == (whole.train_f2, whole.train_ap, 60)
