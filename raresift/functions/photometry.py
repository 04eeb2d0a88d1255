"""Column expressions over magnitudes, colours, quality strings and parallaxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Colour name -> (left band, right band).
COLOURS = {
    "BP_RP": ("BP", "RP"),
    "G_BP": ("G", "BP"),
    "G_RP": ("G", "RP"),
    "J_H": ("J", "H"),
    "H_K": ("H", "Ks"),
    "J_K": ("J", "Ks"),
    "W1_W2": ("W1", "W2"),
    "K_W1": ("Ks", "W1"),
    "G_K": ("G", "Ks"),
    "BP_J": ("BP", "J"),
}
# The seven colours taken within one mission.
LOCAL_COLOURS = ("G_BP", "G_RP", "BP_RP", "J_H", "J_K", "H_K", "W1_W2")
# Character position of a band in its survey's quality string.
TMASS_POSITION = {"J": 0, "H": 1, "Ks": 2}
WISE_POSITION = {"W1": 0, "W2": 1}
# Derived colours of the second stage.
EXTRA_COLOURS = {
    "W2_W3": ("W2", "W3"),
    "W3_W4": ("W3", "W4"),
    "W1_W3": ("W1", "W3"),
    "K_W2": ("Ks", "W2"),
    "J_W2": ("J", "W2"),
    "G_W1": ("G", "W1"),
}
MAGNITUDE_SNR = 1.0857362047581296  # fixed value: 2.5 / ln(10)
POE_LEVELS = (1, 2, 3, 5)  # fixed values: parallax signal-to-noise floors
FAMILIES = {"strict": ("A",), "relaxed": ("A", "B")}  # fixed values
SUBSETS = ("photometry", "parallax_soft", *(f"poe_{k}" for k in POE_LEVELS))
VARIANTS = tuple(f"{family}_{subset}" for family in FAMILIES for subset in SUBSETS)


def not_nan(column: str) -> Column:
    """NaN becomes NULL, so that later comparisons are false as intended."""
    return F.when(~F.isnan(column), F.col(column))


def with_colours(df: DataFrame, names: Sequence[str] = tuple(COLOURS), *, keep_existing: bool = False) -> DataFrame:
    """Add magnitude differences in one projection."""
    wanted = [n for n in names if not (keep_existing and n in df.columns)]
    return df.withColumns({n: F.col(COLOURS[n][0]) - F.col(COLOURS[n][1]) for n in wanted})


def with_derived(df: DataFrame) -> DataFrame:
    """Extra colours, flux and magnitude S/N and total proper motion, where inputs exist."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    for name, (left, right) in EXTRA_COLOURS.items():
        if name not in have and {left, right} <= have:
            new[name] = F.col(left) - F.col(right)
    for band in ("G", "BP", "RP"):
        if f"{band}_flux_snr" not in have and {f"{band}_flux", f"{band}_flux_error"} <= have:
            new[f"{band}_flux_snr"] = F.try_divide(f"{band}_flux", f"{band}_flux_error")
    for band in ("J", "H", "Ks", "W1", "W2", "W3", "W4"):
        if f"{band}_snr" not in have and {band, f"{band}_error"} <= have:
            new[f"{band}_snr"] = F.try_divide(F.lit(MAGNITUDE_SNR), F.col(f"{band}_error"))
    if "pm_total" not in have and {"pmra", "pmdec"} <= have:
        new["pm_total"] = F.sqrt(F.col("pmra") * F.col("pmra") + F.col("pmdec") * F.col("pmdec"))
    return df.withColumns(new)


def log10_positive(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def inverse_signed_log1p(y: Column) -> Column:
    return F.signum(y) * F.expm1(F.abs(y))


TRANSFORMS = {"log10_positive": log10_positive, "signed_log1p": signed_log1p}


def transform_valid(x: Column, y: Column, transform: str) -> Column:
    """Rows on which both colours can be transformed."""
    base = x.isNotNull() & y.isNotNull()
    if transform == "log10_positive":
        return base & F.coalesce((x > 0) & (y > 0), F.lit(False))
    if transform == "signed_log1p":
        return base
    raise ValueError(f"unknown transform: {transform}")


def all_true(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def any_true(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def letter_in(quality: str, position: int, allowed: Sequence[str]) -> Column:
    """Is the letter at ``position`` allowed? Short or NULL strings are not."""
    return F.coalesce(F.substring(quality, position + 1, 1).isin(list(allowed)), F.lit(False))


def photometry_ok(required: Sequence[str], tmass: Sequence[str], wise: Sequence[str]) -> Column:
    """All required columns present and every required band of allowed quality."""
    rules = [F.col(c).isNotNull() for c in required]
    rules += [letter_in("tmass_quality", p, tmass) for b, p in TMASS_POSITION.items() if b in required]
    rules += [letter_in("wise_quality", p, wise) for b, p in WISE_POSITION.items() if b in required]
    return all_true(rules)


def quality_prefix_ok(required: Sequence[str], tmass_prefix: str, wise_prefix: str) -> Column:
    rules = [F.col(c).isNotNull() for c in required]
    rules.append(F.coalesce(F.col("tmass_quality").startswith(tmass_prefix), F.lit(False)))
    rules.append(F.coalesce(F.col("wise_quality").startswith(wise_prefix), F.lit(False)))
    return all_true(rules)


def parallax_ok(min_parallax: float = 0.0, min_over_error: float | None = None) -> Column:
    """Strict parallax floor and inclusive signal-to-noise floor; NULL and NaN fail."""
    parallax = not_nan("parallax")
    rule = parallax > min_parallax
    if min_over_error is not None:
        rule = rule & (not_nan("parallax_over_error") >= min_over_error)
    return F.coalesce(rule, F.lit(False))


def variant_photometry(variant: str) -> Column:
    allowed = FAMILIES["strict"] if variant.startswith("strict_") else FAMILIES["relaxed"]
    return all_true(
        [letter_in("tmass_quality", p, allowed) for p in range(3)]
        + [letter_in("wise_quality", p, allowed) for p in range(2)]
    )


def variant_astrometry(variant: str) -> Column:
    if variant.endswith("_photometry"):
        return F.lit(True)
    if variant.endswith("_parallax_soft"):
        return parallax_ok()
    for level in POE_LEVELS:
        if variant.endswith(f"_poe_{level}"):
            return parallax_ok(0.0, float(level))
    raise ValueError(f"unknown variant: {variant}")


def bands_available(bands: Sequence[str], min_quality: str, *, require_optical: bool = True) -> Column:
    """Bands present with at least ``min_quality`` ('A', or 'B' meaning A or B)."""
    allowed = ("A",) if min_quality == "A" else ("A", "B")
    rules = [F.col(c).isNotNull() for c in (("G", "BP", "RP") if require_optical else ())]
    for band in bands:
        rules.append(F.col(band).isNotNull())
        if band in TMASS_POSITION:
            rules.append(letter_in("tmass_quality", TMASS_POSITION[band], allowed))
        else:
            rules.append(letter_in("wise_quality", WISE_POSITION[band], allowed))
    return all_true(rules)


def within_bounds(bounds: Mapping[str, tuple[float, float]]) -> Column:
    """AND of inclusive colour ranges."""
    return all_true([F.col(c).between(float(lo), float(hi)) for c, (lo, hi) in bounds.items()])


def near_any_plane(planes: Sequence[Mapping]) -> Column:
    """Within the largest threshold of any slope/intercept corner of any plane."""
    corners = []
    for p in planes:
        x, y = signed_log1p(F.col(p["x"])), signed_log1p(F.col(p["y"]))
        for slope in (p["slope_min"], p["slope_max"]):
            for intercept in (p["intercept_min"], p["intercept_max"]):
                corners.append(F.abs(y - (F.lit(intercept) + F.lit(slope) * x)) <= F.lit(p["threshold_max"]))
    return any_true(corners)


def quality_letters(column: str, letters: str, bands: int) -> Column:
    """The first ``bands`` letters all come from ``letters``."""
    return F.coalesce(F.col(column).rlike(f"^[{letters}]{{{bands}}}"), F.lit(False))


def letter_count(column: str, letters: str, bands: int = 3) -> Column:
    """How many of the first ``bands`` letters come from ``letters``; NULL counts 0."""
    kept = F.regexp_replace(F.substring(column, 1, bands), f"[^{letters}]", "")
    return F.coalesce(F.length(kept), F.lit(0))
