"""Validators per subtype against plain numpy fits; skip reasons; pairs."""

import numpy as np
import pytest

import __spark_entry__ as entry
from raresift.operators import learning, second_layer as sl

SETS = {"pair": ["a", "b", "empty"], "wide": ["a", "b", "c"], "few": ["a", "empty"]}
FIT = {"min_features": 2, "min_train": 15, "trees": 20, "rounds": 40, "passes": 2}


@pytest.fixture(scope="module")
def made(spark):
    rng, rows = np.random.default_rng(11), []
    for k in range(400):
        target = int(k < 170)
        subtype = ("WN" if k < 100 else "WC" if k < 160 else "WO") if target else "WN"  # a negative's subtype does not count
        centre = {"WN": (0, 0), "WC": (4, -2), "WO": (9, 9)}[subtype] if target else (1.5, 2.5)
        a, b, c = rng.normal(centre[0], 1.0), rng.normal(centre[1], 0.5) + (0.3 * k % 2), rng.normal()
        split = ("holdout", "train", "train", "train", "threshold_calibration")[k % 5]
        split = "train" if target and split == "threshold_calibration" else split
        rows.append((k, target, subtype, split, float(a), None if k % 13 == 0 else float(b), float("nan") if k % 29 == 0 else float(c), None))
    table = spark.createDataFrame(rows, "source_id long, target int, subtype string, modeling_split string, a double, b double, c double, empty double")
    results, scores = sl.fit_validators(table, SETS, ["WN", "WC", "WO"], **FIT)
    return rows, {(r.feature_set, r.subtype, r.method): r for r in results.collect()}, scores.toPandas()


def matrix(rows, subtype, width):
    train = [r for r in rows if r[1] == 1 and r[2] == subtype and r[3] == "train"]
    raw = lambda some: np.array([[np.nan if v is None else v for v in r[4:4 + width]] for r in some], float)
    own, every = raw(train), raw(rows)
    median = np.nanmedian(own, axis=0)
    fill = lambda x: np.where(np.isnan(x), median, x)
    mean, std = fill(own).mean(axis=0), fill(own).std(axis=0)
    return (fill(own) - mean) / std, (fill(every) - mean) / std


def plain_mixture(z, every, rounds):
    d, cov = z.shape[1], np.cov(z.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    means = z.mean(axis=0) + np.array([[-1.0], [1.0]]) * np.sqrt(values[-1]) * vectors[:, -1]
    weights, covs = np.full(2, 0.5), [cov + 1e-5 * np.eye(d)] * 2

    def parts(x):
        return np.stack([
            np.log(w) - 0.5 * (((x - m) @ np.linalg.inv(c) * (x - m)).sum(axis=1) + np.log(np.linalg.det(c)) + d * np.log(2 * np.pi))
            for w, m, c in zip(weights, means, covs)
        ], axis=1)

    for _ in range(rounds):
        share = np.exp(parts(z))
        share /= share.sum(axis=1, keepdims=True)
        fresh = np.array([share[:, k] @ z / share[:, k].sum() for k in range(2)])
        covs = [((z - fresh[k]) * share[:, k, None]).T @ (z - fresh[k]) / share[:, k].sum() + 1e-5 * np.eye(d) for k in range(2)]
        moved, means, weights = np.abs(fresh - means).max(), fresh, share.mean(axis=0)
        if moved < 1e-4:
            break
    return np.log(np.exp(parts(every)).sum(axis=1))


def plain_covariance(z, every, support, passes):
    kept = z
    for step in range(passes + 1):
        centre, inverse = kept.mean(axis=0), np.linalg.pinv(np.cov(kept.T, bias=True) + 1e-5 * np.eye(z.shape[1]))
        distance = lambda x: ((x - centre) @ inverse * (x - centre)).sum(axis=1)  # noqa: B023, E731
        if step < passes:
            kept = z[distance(z) <= np.quantile(distance(z), support)]
    return -distance(every)


@pytest.mark.parametrize("name,subtype,width", [("pair", "WN", 2), ("pair", "WC", 2), ("wide", "WN", 3)])
def test_fits_equal_plain_ones(made, name, subtype, width):
    rows, results, scores = made
    z, every = matrix(rows, subtype, width)
    # An axis of the first split may point either way, which only swaps the components.
    plain = {"gaussian_mixture": plain_mixture(z, every, FIT["rounds"]), "robust_covariance": plain_covariance(z, every, 0.9, FIT["passes"])}
    for method, expected in plain.items():
        mine = scores[(scores.feature_set == name) & (scores.subtype == subtype) & (scores.method == method)].sort_values("source_id")
        want = [k for k, r in enumerate(rows) if r[1] == 0 or r[2] == subtype]
        assert mine.source_id.tolist() == want
        assert np.allclose(mine.score, expected[want], rtol=1e-6, atol=1e-6)


def test_thresholds_rates_and_areas(made):
    rows, results, scores = made
    for (name, subtype, method), row in results.items():
        if row.status != "accepted":
            continue
        mine = scores[(scores.feature_set == name) & (scores.subtype == subtype) & (scores.method == method)]
        train = mine[(mine.modeling_split == "train") & (mine.target == 1)]
        assert row.threshold == pytest.approx(np.quantile(train.score, 0.1)) and row.train_positive_count == len(train)
        hold = mine[mine.modeling_split == "holdout"]
        good, bad = hold[hold.target == 1].score.to_numpy(), hold[hold.target == 0].score.to_numpy()
        assert (row.holdout_positive_count, row.holdout_negative_count) == (len(good), len(bad))
        assert row.holdout_positive_retention == pytest.approx((good >= row.threshold).mean())
        assert row.holdout_negative_pass_rate == pytest.approx((bad >= row.threshold).mean())
        area = ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))
        assert row.holdout_roc_auc == pytest.approx(area, abs=2e-6)
        assert row.calibration_negative_count == sum(r[1] == 0 and r[3] == "threshold_calibration" for r in rows)


def test_reasons_are_rows(made):
    _, results, _ = made
    reasons = {key: row.reason for key, row in results.items() if row.status == "skipped"}
    assert reasons == {
        ("few", "all", "all"): "insufficient_available_features",
        **{(name, "WO", method): "insufficient_train_positives" for name in ("pair", "wide") for method in sl.METHODS},
    }
    assert results["pair", "WN", "isolation_forest"].missing_features == "empty" and len(results) == 1 + 2 * 3 * 3


def test_pairs_are_one_to_one(spark):
    scores = spark.createDataFrame(
        [("f", "m", s, k, 0.1 * k, k % 2 == (s == "WN")) for s in ("WN", "WC") for k in range(4)] + [("g", "m", "WN", 0, 0.5, True)],
        "feature_set string, method string, subtype string, source_id long, score double, passed boolean",
    )
    cases = spark.createDataFrame([(k,) for k in range(3)], "source_id long")
    found = sl.validator_pairs(cases, scores, names={"WN": "wn", "WC": "wc"}).collect()
    assert {(r.feature_set, r.source_id, r.wn_pass, r.wc_pass, r.second_layer_pass) for r in found} == {
        ("f", k, k % 2 == 1, k % 2 == 0, True) for k in range(3)
    }
    with pytest.raises(ValueError, match="one to one"):
        sl.validator_pairs(cases, scores.unionByName(scores.where("source_id = 1 AND subtype = 'WC'")), names={"WN": "wn", "WC": "wc"})
    with pytest.raises(ValueError, match="one to one"):
        sl.validator_pairs(cases.unionByName(spark.createDataFrame([(77,)], "source_id long")), scores, names={"WN": "wn", "WC": "wc"})
    assert sl.validator_pairs(cases, scores.where("subtype = 'WN'"), names={"WN": "wn", "WC": "wc"}).count() == 0


def test_rows_that_walk_side_by_side_end_in_the_leaves_of_their_trees():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(64, 3))
    trees = [{n: (f, at, path) for n, f, at, path in learning.grow_tree(points, np.random.default_rng(k), 64)} for k in range(7)]
    x = np.vstack([points, rng.normal(scale=3.0, size=(50, 3))])

    def walk(row, tree):
        node = 0
        while tree[node][0] >= 0:
            node = 2 * node + (1 if row[tree[node][0]] < tree[node][1] else 2)
        return tree[node][2]

    total = np.array([sum(walk(row, tree) for tree in trees) for row in x])
    assert np.allclose(learning.forest_scores(x, learning.flat_trees(trees), 64), -(2.0 ** (-total / 7 / learning.path_length(64))))


def test_registered_validators_build_on_the_catalogue(spark):
    """The queries hand the modelling rows over as a table of rows, and judge each by its own columns."""
    rows = entry.queries()["ml_13_one_class_models"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 10 and {r["feature_set"] for r in rows} == {"colours", "few"}


def test_scores_stay_as_wide_as_the_rows(spark, made):
    """A row that three validators judge crosses to Python and back once: one output row for each input row."""
    rows = spark.createDataFrame([(1, 0, None, "holdout", 0.1, 0.2), (2, 1, "WN", "train", 0.3, 0.1)],
                                 "source_id long, target int, subtype string, modeling_split string, a double, b double")
    group = lambda subtype: sl.Group("pair", subtype, ["a", "b"], 20, median=np.zeros(2), centre=np.zeros(2), scatter=np.eye(2))
    wide = sl._scores(rows, [(group("WN"), "robust_covariance"), (group("WC"), "robust_covariance")])
    found = {r["source_id"]: (r["s0"], r["s1"]) for r in wide.collect()}
    assert found[1][0] == found[1][1] < 0 and found[2][0] < 0 and found[2][1] is None
    assert {(r["source_id"], r["number"]) for r in sl._unfolded(wide, 2, "source_id").collect()} == {(1, 0), (1, 1), (2, 0)}
