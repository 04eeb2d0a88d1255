"""Colour-locus bands: fitting, annotation and exact-variant masks.

Fits are a handful of rows per variant and live on the driver as parameters;
everything done to catalogue rows is a generated projection.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions.photometry import (
    LOCAL_COLOURS,
    TRANSFORMS,
    VARIANTS,
    all_true,
    parallax_ok,
    photometry_ok,
    signed_log1p,
    transform_valid,
    variant_astrometry,
    variant_photometry,
    with_colours,
    FAMILIES,
    POE_LEVELS,
)
from raresift.operators.quantiles import exact_quantiles, mad_sigma
from raresift.operators.ranking import has_bit
from raresift.session import cut_lineage

# Candidate planes (x colour, y colour).
PLANES = (
    ("G_BP", "G_RP"),
    ("G_BP", "BP_RP"),
    ("G_RP", "BP_RP"),
    ("J_H", "J_K"),
    ("J_K", "H_K"),
    ("J_H", "H_K"),
)
PLANE_COLOURS = ("G_BP", "G_RP", "BP_RP", "J_H", "J_K", "H_K")
# Stable bit of each variant; 6-7 and 14-15 are reserved.
VARIANT_BITS = {
    "strict_photometry": 0,
    "strict_parallax_soft": 1,
    "strict_poe_1": 2,
    "strict_poe_2": 3,
    "strict_poe_3": 4,
    "strict_poe_5": 5,
    "relaxed_photometry": 8,
    "relaxed_parallax_soft": 9,
    "relaxed_poe_1": 10,
    "relaxed_poe_2": 11,
    "relaxed_poe_3": 12,
    "relaxed_poe_5": 13,
}


@dataclass(frozen=True)
class Band:
    """A fitted line with its half width, in transformed colours."""

    x: str
    y: str
    slope: float
    intercept: float
    threshold: float

    @property
    def name(self) -> str:
        return f"{self.x}__{self.y}"

    def margin_text(self, prefix: str = "t_") -> str:
        """The margin as expression text: one call builds it, however many bands there are."""
        line = f"{self.intercept!r}D + {self.slope!r}D * {prefix}{self.x}"
        return f"({self.threshold!r}D - abs({prefix}{self.y} - ({line})))"

    def margin(self, prefix: str = "t_") -> Column:
        """Distance inside the band; negative outside, NULL when a colour is missing."""
        return F.expr(self.margin_text(prefix))


@dataclass(frozen=True)
class MaskSchema:
    """Which variant owns which bit; independent of the order variants are given in."""

    bits: tuple[tuple[str, int], ...]
    family: str = "compatible_variant_mask"
    major_version: int = 1

    @property
    def sha256(self) -> str:
        entries = [{"bit": b, "value": 1 << b, "variant": v} for v, b in self.bits]
        payload = {"entries": entries, "family": self.family, "major_version": self.major_version}
        return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @property
    def version(self) -> str:
        return f"{self.family}_v{self.major_version}_{self.sha256[:12]}"

    def bit(self, variant: str) -> int:
        return dict(self.bits)[variant]


def mask_schema(variants: Sequence[str], registry: Mapping[str, int] = VARIANT_BITS) -> MaskSchema:
    """The registry cut to ``variants``, by bit; a long mask has room for 64 variants, each with a bit of its own."""
    wanted = {v: registry.get(v) for v in variants}
    by_bit: dict[int, str] = {}
    for variant, bit in wanted.items():
        if bit is None:
            raise ValueError(f"no stable bit is registered for {variant}")
        if not 0 <= bit < 64:
            raise ValueError(f"bit {bit} of {variant} lies outside a long")
        if by_bit.setdefault(bit, variant) != variant:
            raise ValueError(f"{variant} and {by_bit[bit]} share bit {bit}")
    return MaskSchema(tuple((by_bit[bit], bit) for bit in sorted(by_bit)))


# ---- nested datasets --------------------------------------------------------


def variant_rules(required: Sequence[str]) -> dict[str, Column]:
    """Membership rule of each of the twelve nested datasets."""
    rules = {}
    for family, letters in FAMILIES.items():
        base = photometry_ok(required, letters, letters)
        rules[f"{family}_photometry"] = base
        rules[f"{family}_parallax_soft"] = base & parallax_ok()
        for level in POE_LEVELS:
            rules[f"{family}_poe_{level}"] = base & parallax_ok(0.0, float(level))
    return rules


def explode_variants(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One scan: each row once per dataset it belongs to, with family and subset labels."""
    names = F.array(*[F.when(rule, name) for name, rule in variant_rules(required).items()])
    spread = df.withColumn("variant", F.explode(names)).where(F.col("variant").isNotNull())
    return spread.withColumns(
        {
            "dataset_family": F.substring_index("variant", "_", 1),
            "astrometric_subset": F.regexp_replace("variant", "^(strict|relaxed)_", ""),
        }
    )


# ---- fitting ------------------------------------------------------------------


def _long_planes(df: DataFrame, planes, transform: str, by: Sequence[str]) -> DataFrame:
    """(group, plane, tx, ty) rows of all planes in one scan; tx is NULL where invalid."""
    change = TRANSFORMS[transform]
    rows = []
    for x, y in planes:
        ok = transform_valid(F.col(x), F.col(y), transform)
        rows.append(
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                F.when(ok, change(F.col(x))).alias("tx"),
                F.when(ok, change(F.col(y))).alias("ty"),
            )
        )
    return df.select(*by, F.inline(F.array(*rows)))


def fit_planes(
    df: DataFrame,
    planes: Sequence[tuple[str, str]] = PLANES,
    *,
    by: Sequence[str] = (),
    transform: str = "signed_log1p",
    min_fraction: float = 1.0,
    quantile: float = 0.975,
) -> DataFrame:
    """Least-squares line of every plane (and group) with its residual statistics.

    Planes with too few usable rows come back invalid with NULL parameters.
    """
    long = _long_planes(df, planes, transform, by)
    keys = [*by, "x", "y"]
    lines = cut_lineage(long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("tx").alias("n"),
        F.regr_slope("ty", "tx").alias("slope"),
        F.regr_intercept("ty", "tx").alias("intercept"),
        F.regr_r2("ty", "tx").alias("r2"),
    ).withColumn("positive_fraction", F.col("n") / F.col("rows")))
    fitted = lines.where(F.col("positive_fraction") >= min_fraction)
    # Three quantile passes read the residuals, so they are written once: keys and one number.
    residuals = cut_lineage(
        long.where(F.col("tx").isNotNull()).join(fitted.select(*keys, "slope", "intercept"), keys).select(
            *keys, (F.col("ty") - (F.col("intercept") + F.col("slope") * F.col("tx"))).alias("residual")
        )
    )
    sigma = mad_sigma(residuals, "residual", by=keys)
    tail = exact_quantiles(
        residuals.withColumn("size", F.abs("residual")), "size", [quantile], by=keys, names=["quantile_threshold"]
    )
    stats = sigma.join(tail, keys)
    out = lines.join(stats, keys, "left").withColumn("valid", F.col("quantile_threshold").isNotNull())
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in ("slope", "intercept", "r2")}).drop("rows")


def fit_huber(
    df: DataFrame, x: str, y: str, *, transform: str = "signed_log1p", epsilon: float = 1.35, alpha: float = 1e-4
) -> dict:
    """Robust line with Spark's Huber loss (concomitant scale), one plane."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    change = TRANSFORMS[transform]
    rows = df.where(transform_valid(F.col(x), F.col(y), transform)).select(
        change(F.col(x)).alias("tx"), change(F.col(y)).alias("label")
    )
    data = VectorAssembler(inputCols=["tx"], outputCol="features").transform(rows).select("features", "label").persist()
    try:
        n = data.count()
        model = LinearRegression(
            loss="huber", epsilon=epsilon, regParam=alpha / max(n, 1), standardization=False, maxIter=500, tol=1e-9
        ).fit(data)
    finally:
        data.unpersist()
    return {"x": x, "y": y, "n": n, "slope": float(model.coefficients[0]), "intercept": float(model.intercept),
            "scale": float(model.scale)}


def line_versus_parabola(df: DataFrame, x: str, y: str) -> DataFrame:
    """R² of a line and of a parabola from pairwise correlations, in one aggregate."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) * F.col(x)).alias("q")
    )
    c = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("x", "y").alias("xy"),
        F.corr("q", "y").alias("qy"),
        F.corr("x", "q").alias("xq"),
    )
    xy, qy, xq = F.col("xy"), F.col("qy"), F.col("xq")
    linear = xy * xy
    quadratic = (xy * xy + qy * qy - 2 * xy * qy * xq) / (1 - xq * xq)
    return c.select(
        "n", linear.alias("linear_r2"), quadratic.alias("quadratic_r2"), (quadratic - linear).alias("quadratic_r2_gain")
    )


# ---- annotation -----------------------------------------------------------------


def annotate_plane(df: DataFrame, fit: Mapping, *, k_sigma: float = 2.0, method: str = "sigma_mad") -> DataFrame:
    """Residual, validity, outlier and keep columns for one fitted plane."""
    if not fit["valid"]:
        raise ValueError(f"plane {fit['x']} -> {fit['y']} has no valid fit")
    transform = fit.get("transform", "signed_log1p")
    if method == "sigma_mad":
        threshold = k_sigma * fit["sigma_mad"]
    elif method == "empirical_quantile":
        threshold = fit["quantile_threshold"]
    else:
        raise ValueError(f"unknown threshold method: {method}")
    change, x, y = TRANSFORMS[transform], F.col(fit["x"]), F.col(fit["y"])
    ok = transform_valid(x, y, transform)
    first = df.withColumns(
        {
            "color_locus_valid": ok,
            "color_locus_log_x": F.when(ok, change(x)),
            "color_locus_log_y": F.when(ok, change(y)),
        }
    )
    predicted = F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("color_locus_log_x")
    second = first.withColumns(
        {
            "color_locus_predicted_log_y": predicted,
            "color_locus_residual": F.col("color_locus_log_y") - predicted,
        }
    )
    outlier = F.col("color_locus_valid") & F.coalesce(F.abs("color_locus_residual") > threshold, F.lit(False))
    sigma = fit["sigma_mad"]
    return second.withColumns(
        {
            "color_locus_normalized_residual": F.col("color_locus_residual") / sigma
            if sigma > 0
            else F.lit(None).cast("double"),
            "color_locus_outlier": outlier,
            "color_locus_keep": F.col("color_locus_valid") & ~outlier,
            "color_locus_x": F.lit(fit["x"]),
            "color_locus_y": F.lit(fit["y"]),
            "color_locus_transform": F.lit(transform),
            "color_locus_slope": F.lit(fit["slope"]),
            "color_locus_intercept": F.lit(fit["intercept"]),
            "color_locus_r2": F.lit(fit["r2"]),
            "color_locus_sigma_mad": F.lit(sigma),
            "color_locus_threshold": F.lit(threshold),
        }
    )


def with_transformed(df: DataFrame, colours: Sequence[str] = PLANE_COLOURS) -> DataFrame:
    """The transformed colours, computed once and shared by every band.

    ``t_`` columns keep NULL. ``z_`` columns read 0 instead and go together
    with ``planes_valid``: without NULL checks the code of many bands stays
    small enough to be compiled.
    """
    plain = {f"t_{c}": signed_log1p(F.col(c)) for c in colours}
    filled = {f"z_{c}": F.coalesce(F.col(f"t_{c}"), F.lit(0.0)) for c in colours}
    present = all_true([F.col(c).isNotNull() for c in colours])
    return df.withColumns(plain).withColumns({**filled, "planes_valid": present})


def _helpers(colours: Sequence[str] = PLANE_COLOURS) -> list[str]:
    return [*(f"t_{c}" for c in colours), *(f"z_{c}" for c in colours), "planes_valid"]


def annotate_bands(df: DataFrame, bands: Sequence[Band], *, min_outlier_planes: int = 2) -> DataFrame:
    """Per-band columns, then validity over all bands and the outlier-count rule."""
    shared = with_transformed(df, sorted({c for b in bands for c in (b.x, b.y)}))
    per_band = {}
    for b in bands:
        prefix = f"color_locus_{b.name}"
        valid = F.col(b.x).isNotNull() & F.col(b.y).isNotNull()
        predicted = F.lit(b.intercept) + F.lit(b.slope) * F.col(f"t_{b.x}")
        outlier = valid & F.coalesce(b.margin() < 0, F.lit(False))
        per_band |= {
            f"{prefix}_log_x": F.col(f"t_{b.x}"),
            f"{prefix}_log_y": F.col(f"t_{b.y}"),
            f"{prefix}_predicted_log_y": predicted,
            f"{prefix}_residual": F.col(f"t_{b.y}") - predicted,
            f"{prefix}_valid": valid,
            f"{prefix}_outlier": outlier,
            f"{prefix}_keep": valid & ~outlier,
            f"{prefix}_slope": F.lit(b.slope),
            f"{prefix}_intercept": F.lit(b.intercept),
            f"{prefix}_threshold": F.lit(b.threshold),
        }
    wide = shared.withColumns(per_band)
    count = sum(F.col(f"color_locus_{b.name}_outlier").cast("int") for b in bands)
    counted = wide.withColumns(
        {
            "color_locus_valid": all_true([F.col(f"color_locus_{b.name}_valid") for b in bands]),
            "color_locus_outlier_plane_count": count,
            "color_locus_planes": F.lit(",".join(b.name for b in bands)),
        }
    )
    outlier = F.col("color_locus_outlier_plane_count") >= min_outlier_planes
    return counted.withColumns(
        {"color_locus_outlier": outlier, "color_locus_keep": F.col("color_locus_valid") & ~outlier}
    ).drop(*_helpers([c for c in {c for b in bands for c in (b.x, b.y)}]))


def band_rules(bands: Sequence[Band], *, min_outlier_planes: int) -> tuple[Column, Column, Column]:
    """(valid, outlier count, keep) over columns made by :func:`with_transformed`."""
    used = sorted({c for b in bands for c in (b.x, b.y)})
    valid = " and ".join(f"t_{c} is not null" for c in used)
    count = " + ".join(f"if({b.margin_text()} < 0, 1, 0)" for b in bands)
    return F.expr(valid), F.expr(count), F.expr(f"({valid}) and ({count}) < {int(min_outlier_planes)}")


def keep_all_planes(bands: Sequence[Band], *, min_outlier_planes: int) -> Column:
    """The keep rule alone, over ``z_`` columns, for bands that use every plane colour."""
    count = " + ".join(f"if({b.margin_text('z_')} < 0, 1, 0)" for b in bands)
    return F.expr(f"planes_valid and ({count}) < {int(min_outlier_planes)}")


# ---- variant masks ----------------------------------------------------------------


def _or_bits(flags: Mapping[str, Column | str], schema: MaskSchema) -> Column:
    # Bits are disjoint, so the OR is a sum.
    if all(isinstance(rule, str) for rule in flags.values()):
        return F.expr(" + ".join(f"if({flags[v]}, {1 << b if b < 63 else -(1 << 63)}L, 0L)" for v, b in schema.bits))
    return sum(
        (F.when(flags[v], F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
         for v, b in schema.bits),
        F.lit(0).cast("long"),
    )


def mask_from_flags(df: DataFrame, schema: MaskSchema, template: str = "exact_variant_keep__{variant}") -> DataFrame:
    """Mask, count and any-flag from per-variant booleans; NULL counts as false."""
    flags = {v: F.coalesce(F.col(template.format(variant=v)), F.lit(False)) for v, _ in schema.bits}
    masked = df.withColumn("compatible_variant_mask", _or_bits(flags, schema))
    return masked.withColumn("compatible_variant_count", F.bit_count("compatible_variant_mask")).withColumn(
        "passes_any_exact_variant", F.col("compatible_variant_count") > 0
    )


def mask_violations(df: DataFrame, schema: MaskSchema, template: str = "exact_variant_keep__{variant}") -> DataFrame:
    """Counts of rows breaking each mask invariant, in one aggregate."""
    bits = [
        F.count_if(has_bit("compatible_variant_mask", b) != F.coalesce(F.col(template.format(variant=v)), F.lit(False)))
        for v, b in schema.bits
    ]
    count = F.col("compatible_variant_count")
    return df.agg(
        sum(bits).alias("bit_disagrees"),
        F.count_if(F.bit_count("compatible_variant_mask") != count).alias("count_disagrees"),
        F.count_if(F.col("passes_any_exact_variant") != (count > 0)).alias("union_disagrees"),
    )


def evaluate_union(
    df: DataFrame, loci: Mapping[str, Sequence[Band]], schema: MaskSchema, *, min_outlier_planes: int = 2,
    diagnostics: bool = False,
) -> DataFrame:
    """Locus, photometry, astrometry and compatible masks of every row.

    The transformed colours are one projection and the per-variant verdicts the
    next, so the 72 residuals read shared columns instead of repeating them.
    """
    colours = with_colours(df, LOCAL_COLOURS, keep_existing=True)
    judged = with_transformed(colours).withColumns(
        {
            **{
                f"exact_locus_keep__{v}": keep_all_planes(loci[v], min_outlier_planes=min_outlier_planes)
                for v, _ in schema.bits
            },
            **{f"quality_keep__{f}": variant_photometry(f"{f}_photometry") for f in FAMILIES},
            **{f"astrometry_keep__{s}": variant_astrometry(f"strict_{s}") for s in _subsets(schema)},
        }
    )
    locus = {v: f"exact_locus_keep__{v}" for v, _ in schema.bits}
    quality = {v: f"quality_keep__{v.split('_', 1)[0]}" for v, _ in schema.bits}
    astro = {v: f"astrometry_keep__{v.split('_', 1)[1]}" for v, _ in schema.bits}
    masked = judged.withColumns(
        {
            "exact_locus_variant_mask": _or_bits(locus, schema),
            "photometry_variant_mask": _or_bits(quality, schema),
            "astrometry_variant_mask": _or_bits(astro, schema),
        }
    )
    compatible = (
        F.col("exact_locus_variant_mask")
        .bitwiseAND(F.col("photometry_variant_mask"))
        .bitwiseAND(F.col("astrometry_variant_mask"))
    )
    out = masked.withColumn("compatible_variant_mask", compatible).withColumns(
        {
            "compatible_variant_count": F.bit_count("compatible_variant_mask"),
            "passes_any_exact_variant": F.col("compatible_variant_mask") != 0,
        }
    )
    if diagnostics:
        out = out.withColumns({f"exact_variant_keep__{v}": has_bit("compatible_variant_mask", b) for v, b in schema.bits})
    else:
        out = out.drop(*[f"exact_locus_keep__{v}" for v, _ in schema.bits])
    return out.drop(
        *_helpers(),
        *[f"quality_keep__{f}" for f in FAMILIES],
        *[f"astrometry_keep__{s}" for s in _subsets(schema)],
    )


def _subsets(schema: MaskSchema) -> list[str]:
    return sorted({v.split("_", 1)[1] for v, _ in schema.bits})


def aggregate_bands(loci: Mapping[str, Sequence[Band]]) -> list[Band]:
    """One wide band per plane: middle slope and intercept, largest threshold."""
    planes: dict[str, list[Band]] = {}
    for bands in loci.values():
        for b in bands:
            planes.setdefault(b.name, []).append(b)
    return [
        Band(
            group[0].x,
            group[0].y,
            (min(b.slope for b in group) + max(b.slope for b in group)) / 2.0,
            (min(b.intercept for b in group) + max(b.intercept for b in group)) / 2.0,
            max(b.threshold for b in group),
        )
        for group in planes.values()
    ]


def legacy_keep(df: DataFrame, bands: Sequence[Band], *, min_outlier_planes: int = 2) -> DataFrame:
    """Rows with all seven local colours and fewer than ``min_outlier_planes`` outlying planes."""
    colours = with_transformed(with_colours(df, LOCAL_COLOURS, keep_existing=True))
    complete = all_true([F.col(c).isNotNull() for c in LOCAL_COLOURS])
    _, count, _ = band_rules(bands, min_outlier_planes=min_outlier_planes)
    counted = colours.withColumn("color_locus_outlier_plane_count", count)
    return counted.where(complete & (F.col("color_locus_outlier_plane_count") < min_outlier_planes)).drop(*_helpers())


def compare_policies(
    df: DataFrame,
    loci: Mapping[str, Sequence[Band]],
    schema: MaskSchema,
    *,
    feature_sets: Mapping[str, Sequence[str]],
    min_outlier_planes: int = 2,
) -> DataFrame:
    """Aggregate band against the union of exact loci, row by row."""
    wide_bands = aggregate_bands(loci)
    union = evaluate_union(df, loci, schema, min_outlier_planes=min_outlier_planes, diagnostics=True)
    shared = with_transformed(union)
    valid, count, keep = band_rules(wide_bands, min_outlier_planes=min_outlier_planes)
    best = {}
    for b in wide_bands:
        rivals = [x.margin() for bands in loci.values() for x in bands if x.name == b.name]
        # All rivals of a plane share its colours, so they are NULL together.
        best[f"best_exact_margin__{b.name}"] = F.greatest(*rivals) if len(rivals) > 1 else rivals[0]
    features = {
        f"features_available__{name}": all_true(
            [F.col(c).isNotNull() if c in shared.columns else F.lit(False) for c in columns]
        )
        for name, columns in feature_sets.items()
    }
    judged = shared.withColumns(
        {
            "aggregated_locus_valid": valid,
            "aggregated_outlier_plane_count": count,
            "aggregated_locus_keep": keep,
            **{f"aggregated_margin__{b.name}": b.margin() for b in wide_bands},
            **best,
            **features,
            "exact_loci_accept_count": F.bit_count("exact_locus_variant_mask"),
        }
    )
    exact, variant, wide = (
        F.col("exact_loci_accept_count") > 0,
        F.col("passes_any_exact_variant"),
        F.col("aggregated_locus_keep"),
    )
    margins = [F.abs(F.col(f"aggregated_margin__{b.name}")) for b in wide_bands]
    return judged.withColumns(
        {
            "passes_any_exact_locus": exact,
            "exact_not_aggregate": exact & ~wide,
            "exact_variant_not_aggregate": variant & ~wide,
            "aggregate_not_exact": wide & ~exact,
            "aggregate_not_exact_variant": wide & ~variant,
            "aggregated_boundary_distance": F.least(*margins),
        }
    ).drop(*_helpers())
