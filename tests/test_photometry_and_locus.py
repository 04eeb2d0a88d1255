import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.functions import photometry as ph, text
from raresift.operators import locus, sampling
from raresift.plans.filter_queries import REQUIRED

STARS = "source_id long, ra double, dec double, G double, BP double, RP double, J double, H double, Ks double, W1 double, W2 double, parallax double, parallax_over_error double, tmass_quality string, wise_quality string"


def star(i, parallax, poe, tq, wq, **gaps):
    row = dict(source_id=i, ra=1.0, dec=1.0, G=10.0, BP=11.0, RP=9.0, J=8.0, H=7.5, Ks=7.0, W1=6.5, W2=6.3)
    row |= dict(parallax=parallax, parallax_over_error=poe, tmass_quality=tq, wise_quality=wq)
    row |= gaps
    return tuple(row[c.split()[0]] for c in STARS.split(", "))


def test_nested_datasets(spark):
    df = spark.createDataFrame(
        [
            star(1, 0.5, 6.0, "AAA", "AAAA"),
            star(2, 0.4, 3.0, "ABA", "BAUU"),
            star(3, 0.1, float("nan"), "BBB", "AB"),
            star(4, -0.2, 9.0, "AAA", "AA"),
            star(5, 0.5, 9.0, "AAC", "AA"),
            star(6, 0.5, 9.0, "AA", "AA"),
            star(7, 0.5, 9.0, None, "AA"),
            star(8, 0.5, 9.0, "AAA", "AA", W2=None),
        ],
        STARS,
    )
    got = {}
    for r in locus.explode_variants(df, REQUIRED).collect():
        got.setdefault(r.variant, set()).add(r.source_id)
    assert got["strict_photometry"] == {1, 4}
    assert got["relaxed_photometry"] == {1, 2, 3, 4}
    assert got["strict_parallax_soft"] == {1}
    assert got["relaxed_parallax_soft"] == {1, 2, 3}
    assert got["relaxed_poe_3"] == {1, 2} and got["relaxed_poe_5"] == {1}


def test_colours_and_transform_validity(spark):
    df = spark.createDataFrame([star(1, 1.0, 1.0, "AAA", "AA")], STARS)
    row = ph.with_colours(df).first()
    assert (row.BP_RP, row.G_BP, row.J_K) == (2.0, -1.0, 1.0) and row.W1_W2 == pytest.approx(0.2)
    pairs = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, -1.0), (None, 1.0)], "x double, y double")
    valid = [r[0] for r in pairs.select(ph.transform_valid(F.col("x"), F.col("y"), "log10_positive")).collect()]
    assert valid == [True, False, False, False]
    back = spark.createDataFrame([(-3.5,), (0.0,), (2.25,)], "x double").select(
        "x", ph.inverse_signed_log1p(ph.signed_log1p(F.col("x"))).alias("y")
    )
    assert all(r.x == pytest.approx(r.y) for r in back.collect())


def test_mask_algebra(spark):
    schema = locus.mask_schema(["relaxed_poe_3", "strict_photometry", "relaxed_photometry"])
    again = locus.mask_schema(["strict_photometry", "relaxed_photometry", "relaxed_poe_3"])
    assert schema.version == again.version and schema.bit("relaxed_poe_3") == 12
    df = spark.createDataFrame(
        [(1, True, True, False), (2, False, True, True), (3, None, False, False), (4, True, True, True)],
        "source_id long, exact_variant_keep__strict_photometry boolean, exact_variant_keep__relaxed_photometry boolean, exact_variant_keep__relaxed_poe_3 boolean",
    )
    out = locus.mask_from_flags(df, schema).orderBy("source_id").collect()
    assert [r.passes_any_exact_variant for r in out] == [True, True, False, True]
    assert [r.compatible_variant_count for r in out] == [2, 2, 0, 3]
    assert list(locus.mask_violations(locus.mask_from_flags(df, schema), schema).first()) == [0, 0, 0]
    with pytest.raises(ValueError):
        locus.mask_schema(["no_such_variant"])


def huber_loss(m, b, s, x, y, e=1.35):
    z = np.abs((y - b - m * x) / s)
    return (s + np.where(z <= e, z**2, 2 * e * z - e**2) * s).sum()


def test_both_robust_fits_reach_the_same_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, 300)
    y = 0.7 * x - 0.3 + rng.normal(0, 0.05, 300)
    y[:15] += 3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "source_id long, x double, y double")
    rows = df.withColumns({"rep": F.lit(0), "w": F.lit(1)})
    m, b, s = sampling.huber_by_replicate(rows, "x", "y", iterations=60)[0]
    best = huber_loss(m, b, s, x, y)
    for dm, db, ds in np.eye(3):
        for step in (1e-3, -1e-3):
            assert huber_loss(m + step * dm, b + step * db, s + step * ds, x, y) >= best - 1e-9
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    fit = LinearRegression(loss="huber", epsilon=1.35, regParam=1e-4 / 300, standardization=False, maxIter=500, tol=1e-9).fit(data)
    assert (fit.coefficients[0], fit.intercept) == pytest.approx((m, b), abs=2e-3)


def test_plane_with_gaps_is_invalid(spark):
    rows = [(float(i), float(i), 0.5 * i if i else None) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    fits = {(f["x"], f["y"]): f for f in locus.fit_planes(df, [("a", "b"), ("a", "c")], min_fraction=0.95).collect()}
    assert fits[("a", "b")]["valid"] and fits[("a", "b")]["slope"] == pytest.approx(1.0)
    assert not fits[("a", "c")]["valid"] and fits[("a", "c")]["slope"] is None


def test_gross_outlier_is_flagged(spark):
    rows = [(i, 0.1 * i, 0.1 * i + (5.0 if i == 9 else 0.001 * (i % 3))) for i in range(10)]
    df = spark.createDataFrame(rows, "source_id long, x double, y double")
    fit = {"x": "x", "y": "y", "valid": True, "slope": 1.0, "intercept": 0.0, "r2": 1.0, "sigma_mad": 0.01, "quantile_threshold": 0.5}
    flagged = locus.annotate_plane(df, fit, method="empirical_quantile").where("color_locus_outlier").collect()
    assert [r.source_id for r in flagged] == [9]


@pytest.mark.parametrize(
    "method,found,main,want",
    [
        ("exact", True, "WR*", "known_wr"),
        ("exact", True, "Galaxy", "catalogued_non_wr"),
        ("exact", True, "Be*", "emission_or_ambiguous"),
        ("exact", True, "star", "generic_or_uninformative"),
        ("position_ambiguous", True, "WR*", "ambiguous_positional_match"),
        ("none", False, None, "no_exact_match"),
    ],
)
def test_dispositions(spark, method, found, main, want):
    df = spark.createDataFrame([(method, found, main, None, None)], "m string, f boolean, t string, o string, s string")
    got = df.select(text.disposition(*[F.col(c) for c in "mftos"])).first()[0]
    assert got == want


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a b  c ", "DR3  12"), ("   ", "Gaia DR3 12"), ("x", None)], "t string, alias string")
    got = df.select(text.clean_scalar(F.col("t")), text.strict_id(F.col("alias")), text.searched_id(F.col("alias"))).collect()
    assert [tuple(r) for r in got] == [("a b c", 12, None), (None, None, 12), ("x", None, None)]
