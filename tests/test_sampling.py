import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import neighbours, sampling
from raresift.operators.neighbours import with_nearest

SCHEMA = "source_id long, target int, a double, b double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(i, int(i < 20), float(rng.normal(2.0 * (i < 20))), float(rng.normal())) for i in range(220)]
    return spark.createDataFrame(data, SCHEMA).cache()


def test_holdout_ignores_order_and_null_class(spark, rows):
    flag = sampling.holdout_flag(0.2, 42, target="target")
    a = {r.source_id: r.h for r in rows.select("source_id", flag.alias("h")).collect()}
    b = {r.source_id: r.h for r in rows.orderBy(F.desc("source_id")).repartition(5).select("source_id", flag.alias("h")).collect()}
    assert a == b
    blank = rows.withColumn("target", F.lit(None).cast("int"))
    assert blank.where(flag).isEmpty()
    exact = rows.where(sampling.holdout_flag(0.2, 42, exact_digest=True)).count()
    assert 15 < exact < 80


def test_folds_are_balanced_within_classes(rows):
    folds = sampling.stratified_folds(rows, splits=4, repeats=2, seed=1)
    sizes = folds.groupBy("repeat", "target", "fold").count().collect()
    for r in sizes:
        assert r["count"] in ((5,) if r.target == 1 else (50,))


def test_folds_shrink_and_refuse(spark, rows):
    few = rows.where("target = 0 or source_id < 3")
    assert sampling.stratified_folds(few, splits=5, repeats=1, seed=1).agg(F.max("fold")).first()[0] == 2
    with pytest.raises(ValueError):
        sampling.stratified_folds(rows.where("target = 0 or source_id < 1"), splits=5, repeats=1, seed=1)


def test_quotas_are_exact_and_proportional(rows):
    out = sampling.sample_by_strata(rows, target_n=60, columns=["a", "b"], bins=3)
    assert out.count() == 60 and out.select("source_id").distinct().count() == 60
    edges = sampling.stratum_edges(rows, ["a", "b"], 3)
    share = {r.stratum: r["count"] / 220 * 60 for r in rows.groupBy(sampling.colour_stratum(edges).alias("stratum")).count().collect()}
    for r in out.groupBy("stratum").count().collect():
        assert abs(r["count"] - share[r.stratum]) < 1.0 + 1e-9


def test_constant_and_missing_columns_in_strata(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 5.0), (3, 1.0, 6.0)], "source_id long, c double, m double")
    edges = sampling.stratum_edges(df, ["c", "m"], 2)
    got = {r.source_id: r.s for r in df.select("source_id", sampling.colour_stratum(edges).alias("s")).collect()}
    assert got[1] == "all|missing" and all(v.startswith("all|") for v in got.values())


def test_neighbours_equal_brute_force_across_blocks(rows):
    got = sampling.nearest_neighbours(rows, rows, ["a", "b"], 3, block_rows=50).toPandas()
    data = rows.toPandas().set_index("source_id")
    points = data[["a", "b"]].to_numpy()
    for i in (0, 57, 219):
        d = np.sqrt(((points - points[i]) ** 2).sum(1))
        d[i] = np.inf
        want = set(data.index[np.argsort(d)[:3]])
        assert set(got[got.source_id == i]["neighbour_id"]) == want


def test_smote_balances_and_stays_on_segments(rows):
    out = sampling.smote(rows, ["a", "b"], k=3)
    counts = {r.target: r["count"] for r in out.groupBy("target").count().collect()}
    assert counts == {0: 200, 1: 200}
    minority = rows.where("target = 1").toPandas()[["a", "b"]].to_numpy()
    synthetic = out.where("source_id is null").toPandas()[["a", "b"]].to_numpy()
    assert len(synthetic) == 180
    for p in synthetic[:40]:
        on_segment = False
        for i in range(len(minority)):
            base, v = minority[i], minority - minority[i]
            t = (v @ (p - base)) / np.maximum((v**2).sum(1), 1e-12)
            gap = np.linalg.norm(base + t[:, None] * v - p, axis=1)
            if ((gap < 1e-9) & (t >= -1e-9) & (t <= 1 + 1e-9)).any():
                on_segment = True
                break
        assert on_segment


def test_random_oversampling_keeps_every_original(rows):
    out = sampling.random_oversample(rows)
    assert out.groupBy("target").count().agg(F.min("count"), F.max("count")).first() == (200, 200)
    assert out.select("source_id").distinct().count() == 220


def test_reduction_splits_are_whole(rows):
    out = sampling.reduce_negatives(rows, ratio=2, columns=["a", "b"])
    assert out.count() == 220
    train = {r.target: r["count"] for r in out.where("modeling_split = 'train'").groupBy("target").count().collect()}
    assert train[0] == 2 * train[1]
    everything = sampling.reduce_negatives(rows, ratio=None, columns=["a", "b"])
    assert everything.where("modeling_split = 'threshold_calibration'").isEmpty()


def test_editing_removes_a_row_unless_all_neighbours_agree(spark):
    # One of the three nearest of row 3 is of the other class: a majority would keep it.
    table = [(1, 0, 0.0), (2, 0, 1.0), (3, 0, 2.1), (4, 1, 3.0), (5, 1, 10.0), (6, 1, 11.0), (7, 1, 12.0), (8, 1, 13.5)]
    df = spark.createDataFrame(table, "source_id long, target int, a double")
    kept = {r.source_id for r in sampling.drop_edited(df, ["a"], k=3).collect()}
    assert kept == {5, 6, 7, 8}


def test_tomek_links_are_mutual_nearest_pairs_of_two_classes(spark):
    table = [(1, 0, 0.0), (2, 1, 0.5), (3, 1, 5.0), (4, 1, 5.2), (5, 0, 9.0)]
    df = spark.createDataFrame(table, "source_id long, target int, a double")
    assert {r.source_id for r in sampling.drop_tomek_links(df, ["a"]).collect()} == {3, 4, 5}


def test_neighbours_do_not_depend_on_the_blocks(rows):
    one = sampling.nearest_neighbours(rows, rows, ["a", "b"], 3).collect()
    many = sampling.nearest_neighbours(rows, rows, ["a", "b"], 3, block_rows=40).collect()
    key = lambda found: sorted((r.source_id, r.place, r.neighbour_id) for r in found)
    assert key(one) == key(many) and len(one) == 660


def _brute_force(data, columns, k):
    points, ids, out = data[columns].to_numpy(), data["source_id"].to_numpy(), {}
    for i, p in zip(ids, points):
        d = np.sqrt(((points - p) ** 2).sum(1))
        out[i] = [int(j) for _, j in sorted((x, j) for x, j in zip(d, ids) if j != i)[:k]]
    return out


def test_neighbours_at_equal_distances_and_copies(spark):
    # A coarse lattice with many copies: ties go to the smaller id, whatever the cells are.
    rng = np.random.default_rng(5)
    data = [(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 6, (300, 2)))]
    df = spark.createDataFrame(data + [(900 + i, 0, 2.0, 2.0) for i in range(100)], SCHEMA)
    got = {r.source_id: [n.neighbour_id for n in r.near] for r in with_nearest(df, df, ["a", "b"], 3, block_rows=20).collect()}
    assert got == _brute_force(df.toPandas(), ["a", "b"], 3)


def test_neighbours_are_sought_near_by_only(spark, monkeypatch):
    # All pairs of 20,000 rows are 4e8 distances; cells need a small part of them.
    seen = spark.sparkContext.accumulator(0)
    plain = neighbours._row_gap

    def counted(a, b):
        seen.add(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(neighbours, "_row_gap", counted)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(rng.normal(size=(20_000, 2)))], SCHEMA)
    assert sampling.nearest_neighbours(df, df, ["a", "b"], 3, block_rows=2_000).count() == 60_000
    assert 0 < seen.value < 4e7


def test_rows_that_lack_a_feature_have_no_neighbours_and_are_none(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 1, 1.0, 0.0), (3, 1, None, 0.0), (4, 0, float("nan"), 0.0)], SCHEMA)
    got = {r.source_id: r.near and [n.neighbour_id for n in r.near] for r in with_nearest(df, df, ["a", "b"], 3).collect()}
    assert got == {1: [2], 2: [1], 3: None, 4: None}
    assert {r.source_id for r in sampling.drop_edited(df, ["a", "b"]).collect()} == {3, 4}


def test_synthetic_rows_at_one_position_have_ids_of_their_own(spark):
    df = spark.createDataFrame([(i, int(i < 4), float(i >= 4) * i, 0.0) for i in range(24)], SCHEMA)
    ids = [r.source_id for r in sampling.smote(df, ["a", "b"], named=True).collect()]
    assert len(ids) == 40 and len(set(ids)) == 40
    # The minority and its synthetic rows share one position and no row of the other class is nearer.
    assert sampling.resample(df, "smote_enn", ["a", "b"]).where("target = 1").count() == 20


def test_bootstrap_weights_reach_the_tail(spark):
    weights = sampling.bootstrap_weights(spark.range(300_000).withColumnRenamed("id", "source_id"), 8, 3)
    top, mean = weights.agg(F.max("w"), F.sum("w") / F.lit(2_400_000.0)).first()
    assert top >= 8 and abs(mean - 1) < 0.01
