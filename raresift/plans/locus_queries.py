"""Locus fitting, annotation and exact-variant mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.functions import photometry as ph
from raresift.operators import locus
from raresift.operators.quantiles import exact_quantiles, mad_sigma, spearman_pairs
from raresift.plans.filter_queries import COLOUR_SQL, REQUIRED, _NOT_NULL, astrometry_sql, quality_sql, signed
from raresift.plans.registry import query
from raresift.session import cut_lineage

# The contract of exact loci: twelve variants by six planes, stated as a rule.
LOCI = {
    variant: [
        locus.Band(x, y, 0.25 + 0.1 * j + 0.01 * i, 0.05 * (j - 2) + 0.02 * (i % 5), 0.70 + 0.03 * i + 0.05 * j)
        for j, (x, y) in enumerate(locus.PLANES)
    ]
    for i, variant in enumerate(ph.VARIANTS)
}
SCHEMA = locus.mask_schema(ph.VARIANTS)
FEATURE_SETS = {"optical": ["G_BP", "BP_RP", "parallax"], "all": ["G_BP", "J_K", "W1_W2", "ruwe"], "lost": ["no_such"]}

T_SQL = COLOUR_SQL + ", t as (select *, " + ", ".join(f"{signed(c)} t_{c}" for c in locus.PLANE_COLOURS) + " from c)"


def margin_sql(b):
    return f"({b.threshold!r}::double - abs(t_{b.y} - ({b.intercept!r}::double + {b.slope!r}::double * t_{b.x})))"


def count_sql(bands):
    return "(" + " + ".join(f"case when {margin_sql(b)} < 0 then 1 else 0 end" for b in bands) + ")"


VALID_SQL = "(" + " and ".join(f"{c} is not null" for c in locus.PLANE_COLOURS) + ")"


def keep_sql(bands, limit=2):
    return f"({VALID_SQL} and {count_sql(bands)} < {limit})"


def _mask(rule):
    return " + ".join(f"case when {rule(v)} then {1 << b} else 0 end" for v, b in SCHEMA.bits)


def quality_of(v):
    return f"coalesce({quality_sql(v.split('_', 1)[0])}, false)"


def astro_of(v):
    return astrometry_sql(v.split("_", 1)[1])


UNION_SQL = (
    T_SQL
    + ", l as (select *, " + ", ".join(f"{keep_sql(LOCI[v])} keep__{v}" for v in ph.VARIANTS) + " from t)"
    + f", m as (select *, cast({_mask(lambda v: f'keep__{v}')} as bigint) exact_locus_variant_mask,"
    + f" cast({_mask(quality_of)} as bigint) photometry_variant_mask,"
    + f" cast({_mask(astro_of)} as bigint) astrometry_variant_mask from l)"
    + """, u as (select *, exact_locus_variant_mask & photometry_variant_mask & astrometry_variant_mask
        compatible_variant_mask from m)"""
)


def pool_union(t, **options):
    return locus.evaluate_union(t.pool, LOCI, SCHEMA, **options)


@query(
    "loc_01_nested_datasets",
    "select variant, family dataset_family, count(*) n, cast(sum(source_id) as bigint) ids from ("
    + " union all ".join(
        f"select '{f}_{s}' variant, '{f}' family, source_id from v_pool where {_NOT_NULL} and {quality_sql(f)} and "
        f"{astrometry_sql(s)}"
        for f in ph.FAMILIES
        for s in ph.SUBSETS
    )
    + ") group by variant, family",
)
def loc_01(t):
    spread = locus.explode_variants(t.pool, REQUIRED)
    return spread.groupBy("variant", "dataset_family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids")
    )


def _fit_sql(source, planes=locus.PLANES, fraction=0.9):
    """Lines and residual statistics of every plane over ``source`` (a view of the c columns)."""
    heads, tails = [], []
    for i, (x, y) in enumerate(planes):
        heads.append(
            f"f{i} as (select count(*) n_rows, count({x} + {y}) n, regr_slope({signed(y)}, {signed(x)}) slope,"
            f" regr_intercept({signed(y)}, {signed(x)}) intercept, regr_r2({signed(y)}, {signed(x)}) r2 from {source}),"
            f" r{i} as (select {signed(y)} - (intercept + slope * {signed(x)}) e from {source}, f{i}"
            f" where {x} is not null and {y} is not null),"
            f" d{i} as (select e, abs(e - (select median(e) from r{i})) dev from r{i})"
        )
        ok = f"n / n_rows >= {fraction}"
        tails.append(
            f"select '{x}' x, '{y}' y, n, n / n_rows positive_fraction, {ok} valid,"
            f" round(case when {ok} then slope end, 6) slope, round(case when {ok} then intercept end, 6) intercept,"
            f" round(case when {ok} then r2 end, 6) r2,"
            f" round(case when {ok} then (select 1.4826 * median(dev) from d{i}) end, 6) sigma_mad,"
            f" round(case when {ok} then (select quantile_cont(abs(e), 0.975) from r{i}) end, 6) quantile_threshold from f{i}"
        )
    return ", ".join(heads), " union all ".join(tails)


_POSITIVES = """p as (select c.* from c where source_id in (select source_id from v_known where label = 'known_wr'))"""


def _positives(t):
    ids = t.known.where("label = 'known_wr'").select("source_id").distinct()
    return ph.with_colours(t.pool, ph.LOCAL_COLOURS).join(ids, "source_id", "left_semi")


_HEADS, _TAILS = _fit_sql("p", fraction=0.85)


@query("loc_02_plane_fits", f"with {COLOUR_SQL}, {_POSITIVES}, {_HEADS} {_TAILS}")
def loc_02(t):
    fits = locus.fit_planes(_positives(t), min_fraction=0.85)
    numbers = ["slope", "intercept", "r2", "sigma_mad", "quantile_threshold"]
    return fits.select("x", "y", "n", "positive_fraction", "valid", *[F.round(c, 6).alias(c) for c in numbers])


@query("loc_02_huber_fits")
def loc_02_huber(t):
    """Robust fit of two planes; tests check it against a perturbation of the loss."""
    rows = _positives(t)
    fits = [locus.fit_huber(rows, x, y) for x, y in (locus.PLANES[0], locus.PLANES[3])]
    return t.spark.createDataFrame(
        [(f["x"], f["y"], f["n"], f["slope"], f["intercept"]) for f in fits],
        "x string, y string, n long, slope double, intercept double",
    )


_FIT = {"x": "G_BP", "y": "G_RP", "valid": True, "slope": 0.5, "intercept": 0.1, "r2": 0.9, "sigma_mad": 0.4,
        "quantile_threshold": 0.75}


@query(
    "loc_03_annotate_plane",
    f"""with {COLOUR_SQL}, a as (select source_id, G_BP is not null and G_RP is not null v, {signed('G_BP')} lx,
      {signed('G_RP')} ly from c), b as (select *, 0.1::double + 0.5::double * lx p from a)
    select source_id, v color_locus_valid, round(case when v then p end, 6) color_locus_predicted_log_y,
      round(ly - p, 6) color_locus_residual, round((ly - p) / 0.4, 6) color_locus_normalized_residual,
      v and coalesce(abs(ly - p) > 0.8, false) color_locus_outlier,
      v and not coalesce(abs(ly - p) > 0.8, false) color_locus_keep, 0.8::double color_locus_threshold from b""",
)
def loc_03(t):
    out = locus.annotate_plane(ph.with_colours(t.pool, ph.LOCAL_COLOURS), _FIT)
    numbers = ["color_locus_predicted_log_y", "color_locus_residual", "color_locus_normalized_residual"]
    return out.select(
        "source_id", "color_locus_valid", *[F.round(c, 6).alias(c) for c in numbers], "color_locus_outlier",
        "color_locus_keep", "color_locus_threshold",
    )


_BANDS = LOCI["relaxed_photometry"]


@query(
    "loc_04_annotate_planes",
    f"""with {T_SQL}, o as (select *, {VALID_SQL} v, {' + '.join(
        f'case when {b.x} is not null and {b.y} is not null and {margin_sql(b)} < 0 then 1 else 0 end' for b in _BANDS)} n
      from t)
    select source_id, v color_locus_valid, n color_locus_outlier_plane_count, n >= 2 color_locus_outlier,
      v and n < 2 color_locus_keep, round(t_{_BANDS[0].y} - ({_BANDS[0].intercept!r}::double
        + {_BANDS[0].slope!r}::double * t_{_BANDS[0].x}), 6) first_residual from o""",
)
def loc_04(t):
    out = locus.annotate_bands(ph.with_colours(t.pool, ph.LOCAL_COLOURS), _BANDS)
    return out.select(
        "source_id", "color_locus_valid", "color_locus_outlier_plane_count", "color_locus_outlier", "color_locus_keep",
        F.round(f"color_locus_{_BANDS[0].name}_residual", 6).alias("first_residual"),
    )


def _outlier_from_fits():
    terms = []
    for i, (x, y) in enumerate(locus.PLANES):
        terms.append(
            f"case when {x} is not null and {y} is not null and abs({signed(y)} - ((select intercept from f{i}) + "
            f"(select slope from f{i}) * {signed(x)})) > 2 * (select 1.4826 * median(dev) from d{i}) then 1 else 0 end"
        )
    return " + ".join(terms)


_JOB_SQL = f"""with {COLOUR_SQL}, {_POSITIVES}, {_HEADS}, s as (select *, {VALID_SQL} v, {_outlier_from_fits()} n,
      source_id in (select source_id from p) positive from c)
    select positive, count(*) n_rows, count(*) filter (where n >= 2) outliers,
      count(*) filter (where v and n < 2) kept from s group by positive"""


@query("loc_05_fit_and_annotate", _JOB_SQL)
def loc_05(t):
    """Fit on the positive class, judge both classes."""
    return fit_and_judge(t.pool, t.known.where("label = 'known_wr'").select("source_id").distinct())


def fit_and_judge(pool, positive_ids, *, min_fraction=0.85):
    tagged = ph.with_colours(pool, ph.LOCAL_COLOURS).join(positive_ids.withColumn("positive", F.lit(True)), "source_id", "left")
    # Fit and verdict read the colours several times, so the joins run once and only these columns are kept.
    rows = cut_lineage(tagged.select(F.coalesce("positive", F.lit(False)).alias("positive"), *locus.PLANE_COLOURS))
    fits = locus.fit_planes(rows.where("positive"), min_fraction=min_fraction)
    # At most one row per plane reaches the driver.
    bands = [
        locus.Band(f["x"], f["y"], f["slope"], f["intercept"], 2.0 * f["sigma_mad"])
        for f in fits.where("valid").orderBy(F.desc("r2"), "x", "y").collect()
    ]
    judged = locus.annotate_bands(rows, bands, min_outlier_planes=2)
    return judged.groupBy("positive").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("color_locus_outlier").alias("outliers"),
        F.count_if("color_locus_keep").alias("kept"),
    )


@query(
    "loc_06_evaluate_locus",
    f"""with {T_SQL} select source_id, {VALID_SQL} "valid", case when {VALID_SQL} then {count_sql(_BANDS)} end outlier_count,
      {keep_sql(_BANDS)} keep, round({margin_sql(_BANDS[0])}, 6) first_margin from t""",
)
def loc_06(t):
    rows = locus.with_transformed(ph.with_colours(t.pool, ph.LOCAL_COLOURS))
    valid, count, keep = locus.band_rules(_BANDS, min_outlier_planes=2)
    return rows.select(
        "source_id", valid.alias("valid"), F.when(valid, count).alias("outlier_count"), keep.alias("keep"),
        F.round(_BANDS[0].margin(), 6).alias("first_margin"),
    )


_FLAGS = {"strict_photometry": "G > 4", "relaxed_photometry": "BP > 3", "relaxed_poe_3": "parallax > 0"}
_FLAG_SCHEMA = locus.mask_schema(list(_FLAGS))


@query(
    "loc_07_mask_from_flags",
    "select source_id, "
    + "cast(" + " + ".join(f"case when {r} then {1 << _FLAG_SCHEMA.bit(v)} else 0 end" for v, r in _FLAGS.items())
    + " as bigint) compatible_variant_mask, "
    + " + ".join(f"case when {r} then 1 else 0 end" for r in _FLAGS.values())
    + " compatible_variant_count, "
    + " or ".join(f"coalesce({r}, false)" for r in _FLAGS.values())
    + " passes_any_exact_variant from v_core",
)
def loc_07(t):
    flagged = t.core.withColumns({f"exact_variant_keep__{v}": F.expr(rule) for v, rule in _FLAGS.items()})
    return locus.mask_from_flags(flagged, _FLAG_SCHEMA).select(
        "source_id", "compatible_variant_mask", "compatible_variant_count", "passes_any_exact_variant"
    )


@query("loc_07_mask_invariants", "select 0::bigint bit_disagrees, 0::bigint count_disagrees, 0::bigint union_disagrees from v_core limit 1")
def loc_07_invariants(t):
    flagged = t.core.withColumns({f"exact_variant_keep__{v}": F.expr(rule) for v, rule in _FLAGS.items()})
    return locus.mask_violations(locus.mask_from_flags(flagged, _FLAG_SCHEMA), _FLAG_SCHEMA)


@query(
    "loc_07_mask_invariant_faults",
    """select count(*) filter (where source_id % 3 = 0) bit_disagrees, count(*) filter (where source_id % 5 = 0) count_disagrees,
      count(*) filter (where source_id % 7 = 0) union_disagrees from v_core""",
)
def loc_07_faults(t):
    """Rows with one wrong flag, a wrong count, a wrong verdict: each kind is found, and nothing else."""
    every = lambda n: F.col("source_id") % n == 0
    flagged = t.core.withColumns({f"exact_variant_keep__{v}": F.expr(rule) for v, rule in _FLAGS.items()})
    masked = locus.mask_from_flags(flagged, _FLAG_SCHEMA)
    count = F.col("compatible_variant_count") + F.when(every(5), 1).otherwise(0)
    first = f"exact_variant_keep__{next(iter(_FLAGS))}"
    spoilt = masked.withColumns({
        first: F.coalesce(F.col(first), F.lit(False)) != every(3), "compatible_variant_count": count,
        "passes_any_exact_variant": (count > 0) != every(7),
    })
    return locus.mask_violations(spoilt, _FLAG_SCHEMA)


@query(
    "loc_08_exact_union",
    f"""with {UNION_SQL} select source_id, exact_locus_variant_mask, photometry_variant_mask, astrometry_variant_mask,
      compatible_variant_mask, cast(bit_count(compatible_variant_mask) as int) compatible_variant_count,
      compatible_variant_mask <> 0 passes_any_exact_variant from u""",
)
def loc_08(t):
    return pool_union(t).select(
        "source_id", "exact_locus_variant_mask", "photometry_variant_mask", "astrometry_variant_mask",
        "compatible_variant_mask", "compatible_variant_count", "passes_any_exact_variant",
    )


WIDE = locus.aggregate_bands(LOCI)
_BY_PLANE = {b.name: [x for bands in LOCI.values() for x in bands if x.name == b.name] for b in WIDE}
POLICY_SQL = (
    UNION_SQL
    + f""", pol as (select *, {VALID_SQL} aggregated_locus_valid, {count_sql(WIDE)} aggregated_outlier_plane_count,
        {keep_sql(WIDE)} aggregated_locus_keep, bit_count(exact_locus_variant_mask) exact_loci_accept_count,
        bit_count(compatible_variant_mask) compatible_variant_count,
        exact_locus_variant_mask <> 0 passes_any_exact_locus, compatible_variant_mask <> 0 passes_any_exact_variant,
        exact_locus_variant_mask <> 0 and not {keep_sql(WIDE)} exact_not_aggregate,
        compatible_variant_mask <> 0 and not {keep_sql(WIDE)} exact_variant_not_aggregate,
        {keep_sql(WIDE)} and exact_locus_variant_mask = 0 aggregate_not_exact,
        {keep_sql(WIDE)} and compatible_variant_mask = 0 aggregate_not_exact_variant,
        """
    + ", ".join(f"{margin_sql(b)} am{i}, greatest({', '.join(margin_sql(x) for x in _BY_PLANE[b.name])}) bm{i}"
                for i, b in enumerate(WIDE))
    + " from u)"
)


def policies(t):
    return locus.compare_policies(t.pool, LOCI, SCHEMA, feature_sets=FEATURE_SETS)


@query(
    "loc_09_policy_comparison",
    f"""with {POLICY_SQL} select source_id, aggregated_locus_keep, cast(exact_loci_accept_count as int) exact_loci_accept_count,
      passes_any_exact_locus, passes_any_exact_variant, exact_not_aggregate, exact_variant_not_aggregate,
      aggregate_not_exact, aggregate_not_exact_variant,
      round(least({', '.join(f'abs(am{i})' for i in range(len(WIDE)))}), 6) aggregated_boundary_distance,
      round(bm0, 6) best_margin,
      G_BP is not null and BP_RP is not null and parallax is not null features_available__optical,
      G_BP is not null and J_K is not null and W1_W2 is not null and ruwe is not null features_available__all,
      false features_available__lost from pol""",
)
def loc_09(t):
    return policies(t).select(
        "source_id", "aggregated_locus_keep", "exact_loci_accept_count", "passes_any_exact_locus",
        "passes_any_exact_variant", "exact_not_aggregate", "exact_variant_not_aggregate", "aggregate_not_exact",
        "aggregate_not_exact_variant", F.round("aggregated_boundary_distance", 6).alias("aggregated_boundary_distance"),
        F.round(f"best_exact_margin__{WIDE[0].name}", 6).alias("best_margin"),
        "features_available__optical", "features_available__all", "features_available__lost",
    )


@query(
    "loc_10_legacy_keep",
    f"""with {T_SQL} select source_id, {count_sql(WIDE)} color_locus_outlier_plane_count from t
    where {VALID_SQL} and W1_W2 is not null and {count_sql(WIDE)} < 2""",
)
def loc_10(t):
    return locus.legacy_keep(t.pool, WIDE).select("source_id", "color_locus_outlier_plane_count")


@query(
    "loc_11_line_or_parabola",
    """with r as (select G x, BP y, G * G q from v_core), a as (select count(*) n, avg(x) mx, avg(q) mq, avg(y) my from r),
    s as (select max(n) n, sum((x - mx) * (x - mx)) xx, sum((q - mq) * (q - mq)) qq, sum((x - mx) * (q - mq)) xq,
      sum((x - mx) * (y - my)) xy, sum((q - mq) * (y - my)) qy, sum((y - my) * (y - my)) yy from r, a)
    select n, round(xy * xy / xx / yy, 6) linear_r2,
      round((((qq * xy - xq * qy) / (xx * qq - xq * xq)) * xy + ((xx * qy - xq * xy) / (xx * qq - xq * xq)) * qy) / yy, 6)
        quadratic_r2 from s""",
)
def loc_11(t):
    out = locus.line_versus_parabola(t.core, "G", "BP")
    return out.select("n", F.round("linear_r2", 6).alias("linear_r2"), F.round("quadratic_r2", 6).alias("quadratic_r2"))


# ---- statistics used around the locus ---------------------------------------------


@query(
    "ag_21_mad_sigma",
    """with m as (select region_no, median(ag) m from v_core group by region_no),
    d as (select c.region_no, median(abs(ag - m)) mad, stddev_pop(ag) sd from v_core c join m using (region_no)
      where ag is not null group by c.region_no)
    select region_no, round(case when mad > 0 then 1.4826 * mad else sd end, 6) sigma_mad from d""",
)
def ag_21(t):
    return mad_sigma(t.core, "ag", by=["region_no"]).withColumn("sigma_mad", F.round("sigma_mad", 6))


_RES = "v as (select source_id, G - BP residual, RP fitted, ruwe x from v_core)"


@query(
    "ag_22_residual_summary",
    f"""with {_RES}, a as (select * from v where residual is not null and fitted is not null and x is not null),
    k as (select *, (rank() over (order by abs(residual)) + (count(*) over (partition by abs(residual)) - 1) / 2e0) ra,
        (rank() over (order by residual) + (count(*) over (partition by residual) - 1) / 2e0) rr,
        (rank() over (order by fitted) + (count(*) over (partition by fitted) - 1) / 2e0) rf,
        (rank() over (order by x) + (count(*) over (partition by x) - 1) / 2e0) rx from a),
    q as (select median(residual) md, avg(residual) mn from v)
    select (select count(*) from a) n, round(mn, 6) residual_mean, round(md, 6) residual_median,
      round((select 1.4826 * median(abs(residual - md)) from v), 6) residual_sigma_mad,
      round((select corr(ra, rf) from k), 6) abs_residual_fitted, round((select corr(ra, rx) from k), 6) abs_residual_x,
      round((select corr(rr, rf) from k), 6) residual_fitted, round((select corr(rr, rx) from k), 6) residual_x from q""",
)
def ag_22(t):
    rows = t.core.select(
        "source_id", (F.col("G") - F.col("BP")).alias("residual"), F.col("RP").alias("fitted"), F.col("ruwe").alias("x")
    ).withColumn("size", F.abs("residual"))
    rows = cut_lineage(rows)  # a dozen passes read these columns
    complete = rows.dropna(subset=["residual", "fitted", "x"])
    parts = [
        complete.agg(F.count(F.lit(1)).alias("n")),
        rows.agg(F.avg("residual").alias("residual_mean")),
        exact_quantiles(rows, "residual", [0.5], names=["residual_median"]),
        mad_sigma(rows, "residual", name="residual_sigma_mad"),
        spearman_pairs(
            complete,
            {
                "abs_residual_fitted": ("size", "fitted"),
                "abs_residual_x": ("size", "x"),
                "residual_fitted": ("residual", "fitted"),
                "residual_x": ("residual", "x"),
            },
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])
