"""Summary tables and invariant checks, each as one combining aggregate.

Per-variant figures are counted side by side (one ``count_if`` per variant) and
turned into rows afterwards, so a twelve-variant report reads its input once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions.photometry import POE_LEVELS, letter_in, parallax_ok
from raresift.functions.photometry import TMASS_POSITION, WISE_POSITION
from raresift.operators.ranking import has_bit


def counts_of(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def tile_audit(rows: DataFrame) -> DataFrame:
    """Per tile: rows, distinct ids and violations of the mask invariants.

    Distinct ids are counted over (tile, id) pairs first, so a dense tile is
    spread over many tasks.
    """
    mask, count = F.col("compatible_variant_mask"), F.col("compatible_variant_count")
    parts = (
        F.col("exact_locus_variant_mask")
        .bitwiseAND(F.col("photometry_variant_mask"))
        .bitwiseAND(F.col("astrometry_variant_mask"))
    )
    passes, known = F.col("passes_any_exact_variant"), F.col("known_source_exclusion").isNotNull()
    per_id = rows.groupBy("tile_id", "source_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(count != F.bit_count(mask)).alias("count_mask_errors"),
        F.count_if(passes != (count > 0)).alias("union_errors"),
        F.count_if(mask != parts).alias("component_mask_errors"),
        F.count_if(passes).alias("accepted_union"),
        F.count_if(passes & known).alias("known_excluded"),
        F.count_if(passes & ~known).alias("eligible_written"),
    )
    sums = ["count_mask_errors", "union_errors", "component_mask_errors", "accepted_union", "known_excluded",
            "eligible_written"]
    return per_id.groupBy("tile_id").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("unique_sources"),
        *[F.sum(c).alias(c) for c in sums],
    )


def registry_audit(measured: DataFrame, registry: DataFrame) -> DataFrame:
    """Full comparison of measured tiles with the registry, with a status per tile."""
    joined = measured.join(registry, "tile_id", "full_outer")
    status = (
        F.when(F.col("n_rows").isNull(), "not_written")
        .when(F.col("acquired").isNull(), "not_registered")
        .when(
            (F.col("n_rows") != F.col("acquired"))
            | (F.col("unique_sources") != F.col("acquired"))
            | (F.col("count_mask_errors") + F.col("union_errors") + F.col("component_mask_errors") > 0)
            | (F.col("accepted_union") != F.col("accepted"))
            | (F.col("eligible_written") != F.col("written")),
            "mismatch",
        )
        .otherwise("ok")
    )
    return joined.withColumn("audit_status", status)


def tile_counts(rows: DataFrame, bits: Mapping[str, int], *, mask: str = "compatible_variant_mask") -> DataFrame:
    """Accepted rows per variant, their union, known rows in it and what was written, with the four rules."""
    union, known = F.col(mask) != 0, F.col("known_source_exclusion").isNotNull()
    out = rows.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("acquired_pre_locus"),
        *[F.count_if(has_bit(mask, b)).alias(f"accepted__{v}") for v, b in bits.items()],
        F.count_if(union).alias("accepted_union"),
        F.count_if(union & known).alias("known_excluded"),
        F.count_if(union & ~known).alias("written"),
    )
    each = F.greatest(*[F.col(f"accepted__{v}") for v in bits])
    return out.withColumn(
        "rules_hold",
        (F.col("accepted_union") <= F.col("acquired_pre_locus"))
        & (each <= F.col("acquired_pre_locus"))
        & (each <= F.col("accepted_union"))
        & (F.col("written") + F.col("known_excluded") == F.col("accepted_union")),
    )


def build_totals(tiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Registry totals by status; sums over no rows are 0."""
    done = F.col("status") == "completed"

    def total(column: str, only_done: bool = False) -> Column:
        value = F.when(done, F.col(column)) if only_done else F.col(column)
        return F.coalesce(F.sum(value), F.lit(0))

    return tiles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("registered_tiles"),
        F.count_if(done).alias("completed_tiles"),
        F.count_if(~done).alias("incomplete_tiles"),
        total("acquired").alias("acquired_rows"),
        total("accepted").alias("accepted_union_rows"),
        total("excluded").alias("known_excluded_rows"),
        total("written").alias("operational_rows"),
        total("bytes").alias("parquet_bytes"),
        total("written", True).alias("completed_rows"),
    )


def subset_counts(pred: DataFrame, group: str, ks: Sequence[int]) -> DataFrame:
    """Members of each group and how many fall within each budget, NULL being its own group."""
    out = pred.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("rank") <= k).alias(f"recovered_at_{k}") for k in ks],
    )
    return out.withColumns({f"recovered_at_{k}_pct": F.col(f"recovered_at_{k}") / F.col("total") for k in ks})


def composition(rows: DataFrame, column: str) -> DataFrame:
    """Counts per value (NULL reads 'unknown') with their share of all rows."""
    counts = rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = counts.agg(F.sum("count").alias("__all"))
    return counts.join(F.broadcast(total)).select(column, "count", (F.col("count") / F.col("__all")).alias("share"))


# ---- policy audit tables ------------------------------------------------------


POLICY_FLAGS = (
    "aggregated_locus_keep", "passes_any_exact_locus", "passes_any_exact_variant", "exact_not_aggregate",
    "exact_variant_not_aggregate", "aggregate_not_exact", "aggregate_not_exact_variant",
)
POLICY_NAMES = {
    "aggregated_locus_keep": "aggregated_keep",
    "passes_any_exact_locus": "any_exact_locus_keep",
    "passes_any_exact_variant": "any_exact_variant_keep",
    "exact_not_aggregate": "exact_locus_not_aggregate",
}


def policy_counts(rows: DataFrame, by: Sequence[str | Column], *extra: Column) -> DataFrame:
    """Acquired rows, the count of each policy flag and any ``extra`` aggregates per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("acquisition_rows"),
        *[F.count_if(flag).alias(POLICY_NAMES.get(flag, flag)) for flag in POLICY_FLAGS],
        *extra,
    )


def with_policy_ratios(counts: DataFrame) -> DataFrame:
    """Loss and growth ratios; a zero denominator gives NULL."""
    c = F.col
    return counts.withColumns(
        {
            "exact_locus_not_aggregate_pct_acquisition": F.try_divide("exact_locus_not_aggregate", "acquisition_rows"),
            "exact_locus_not_aggregate_pct_exact_union": F.try_divide("exact_locus_not_aggregate", "any_exact_locus_keep"),
            "exact_variant_not_aggregate_pct_acquisition": F.try_divide("exact_variant_not_aggregate", "acquisition_rows"),
            "exact_variant_not_aggregate_pct_exact_union": F.try_divide(
                "exact_variant_not_aggregate", "any_exact_variant_keep"
            ),
            "exact_variant_union_growth": F.try_divide(
                c("any_exact_variant_keep") - c("aggregated_keep"), c("aggregated_keep")
            ),
            "acquisition_growth": F.try_divide(c("acquisition_rows") - c("aggregated_keep"), c("aggregated_keep")),
        }
    )


def variant_counts(rows: DataFrame, bits: Mapping[str, int], by: Sequence[str | Column] = ()) -> DataFrame:
    """Per group and variant: locus and compatible counts against the aggregate band.

    Counted wide in one pass over the rows and unfolded over the small result.
    """
    wide_keep = F.col("aggregated_locus_keep")
    measures: list[Column] = [F.count(F.lit(1)).alias("acquisition_rows"), F.count_if(wide_keep).alias("aggregated_keep")]
    for v, b in bits.items():
        exact, full = has_bit("exact_locus_variant_mask", b), has_bit("compatible_variant_mask", b)
        measures += [
            F.count_if(exact).alias(f"a__{v}"),
            F.count_if(exact & ~wide_keep).alias(f"b__{v}"),
            F.count_if(full).alias(f"c__{v}"),
            F.count_if(full & ~wide_keep).alias(f"d__{v}"),
            F.count_if(wide_keep & ~full).alias(f"e__{v}"),
        ]
    wide = rows.groupBy(*by).agg(*measures)
    unfolded = F.inline(F.array(*[
        F.struct(
            F.lit(v).alias("variant"),
            F.lit(b).alias("bit"),
            F.col(f"a__{v}").alias("exact_locus_keep"),
            F.col(f"b__{v}").alias("exact_locus_not_aggregate"),
            F.col(f"c__{v}").alias("exact_variant_keep"),
            F.col(f"d__{v}").alias("exact_variant_not_aggregate"),
            F.col(f"e__{v}").alias("aggregate_not_exact_variant"),
        )
        for v, b in bits.items()
    ]))
    names = [c for c in wide.columns if not c[1:3] == "__"]
    return wide.select(*names, unfolded).withColumn(
        "exact_variant_not_aggregate_pct", F.try_divide("exact_variant_not_aggregate", "exact_variant_keep")
    )


def magnitude_bin(column: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open bins [a, b); NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((F.col(column) >= lo) & (F.col(column) < hi), label).otherwise(out)
    return out


def extinction_bin(column: str) -> Column:
    """Bins (a, b] with NULL as 'missing'."""
    c = F.col(column)
    return (
        F.when(c.isNull(), "missing")
        .when(c <= 0.5, "ag<=0.5")
        .when(c <= 1.5, "0.5<ag<=1.5")
        .when(c <= 3.0, "1.5<ag<=3")
        .otherwise("ag>3")
    )


def strata_summary(rows: DataFrame, dimensions: Mapping[str, str], *, lookup: DataFrame | None = None) -> DataFrame:
    """One pass with GROUPING SETS over single dimensions; ``dimension`` names the set.

    ``lookup`` may add dimensions known per region; it meets the folded counts
    and not the rows.
    """
    columns = list(dimensions.values())
    own = [c for c in columns if lookup is None or c not in lookup.columns]
    # Fold to (all strata, region) first: the expansion then copies a small table.
    flags = ["aggregated_locus_keep", "passes_any_exact_variant", "exact_variant_not_aggregate",
             "aggregate_not_exact_variant"]
    folded = rows.groupBy(*own, "region").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f) for f in flags]
    )
    if lookup is not None:
        folded = folded.join(lookup, "region")
    sets = folded.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("gid"),
        F.count_distinct("region").alias("region_count"),
        F.sum("n").alias("acquisition_rows"),
        *[F.sum(f).alias(POLICY_NAMES.get(f, f)) for f in flags],
    )
    width = len(columns)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (label, column) in enumerate(dimensions.items()):
        only = ((1 << width) - 1) ^ (1 << (width - 1 - i))
        name = F.when(F.col("gid") == only, label).otherwise(name)
        value = F.when(F.col("gid") == only, F.col(column)).otherwise(value)
    return sets.select(
        name.alias("dimension"),
        value.alias("stratum"),
        "region_count",
        "acquisition_rows",
        *[POLICY_NAMES.get(f, f) for f in flags],
        F.try_divide("exact_variant_not_aggregate", "any_exact_variant_keep").alias("pct_exact_union"),
    )


# ---- band availability --------------------------------------------------------

BANDS = ("J", "H", "Ks", "W1", "W2")


def band_combinations(rows: DataFrame, *, min_bands: int = 1) -> DataFrame:
    """Surviving rows of all band subsets, parallax rules and both quality floors in one scan.

    Each row becomes a usable-band mask per quality and a parallax class; the
    counts per (quality, mask, class) are few and are then spread over subsets.
    """
    def usable(quality: str) -> Column:
        allowed = ("A",) if quality == "A" else ("A", "B")
        optical = F.col("G").isNotNull() & F.col("BP").isNotNull() & F.col("RP").isNotNull()
        total = F.lit(0)
        for i, band in enumerate(BANDS):
            if band in TMASS_POSITION:
                good = letter_in("tmass_quality", TMASS_POSITION[band], allowed)
            else:
                good = letter_in("wise_quality", WISE_POSITION[band], allowed)
            total = total + F.when(optical & F.col(band).isNotNull() & good, 1 << i).otherwise(0)
        return total

    level = F.lit(0)
    for step, k in enumerate((None, *[float(v) for v in POE_LEVELS]), start=1):
        level = F.when(parallax_ok(0.0, k), F.lit(step)).otherwise(level)
    tagged = rows.select(
        level.alias("level"),
        F.inline(F.array(*[F.struct(F.lit(q).alias("min_quality"), usable(q).alias("mask")) for q in ("A", "B")])),
    )
    counts = tagged.groupBy("min_quality", "mask", "level").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    subsets = [
        combo for size in range(min_bands, len(BANDS) + 1) for combo in combinations(range(len(BANDS)), size)
    ]
    rules = ("photometry", "parallax_soft", *[f"poe_{k}" for k in POE_LEVELS])
    want = F.array(*[
        F.struct(
            F.lit("+".join(BANDS[i] for i in combo)).alias("bands"),
            F.lit(sum(1 << i for i in combo)).alias("need"),
            F.lit(len(combo)).alias("n_required_bands"),
            F.lit(sum(i < 3 for i in combo)).alias("n_2mass_bands"),
            F.lit(sum(i >= 3 for i in combo)).alias("n_wise_bands"),
        )
        for combo in subsets
    ])
    floors = F.array(*[F.struct(F.lit(r).alias("parallax_filter"), F.lit(i).alias("floor")) for i, r in enumerate(rules)])
    spread = counts.select("*", F.inline(want)).select("*", F.inline(floors))
    met = (F.col("mask").bitwiseAND(F.col("need")) == F.col("need")) & (F.col("level") >= F.col("floor"))
    keys = ["min_quality", "bands", "n_required_bands", "n_2mass_bands", "n_wise_bands", "parallax_filter"]
    summed = spread.groupBy(*keys).agg(F.coalesce(F.sum(F.when(met, F.col("n"))), F.lit(0)).alias("rows"))
    two, wise = F.col("n_2mass_bands"), F.col("n_wise_bands")
    return summed.join(F.broadcast(total)).select(  # one row
        *keys,
        "rows",
        F.try_divide("rows", "total").alias("retention"),
        (((two == 0) | (two >= 2)) & ((wise == 0) | (wise >= 2))).alias("valid_min_2_per_used_mission"),
        ((two == 3) & (wise == 2)).alias("valid_3_2mass_2_wise"),
    )


def colour_envelope(rows: DataFrame, colours: Sequence[str], *, span_fraction: float, absolute: Mapping[str, float]):
    """Padded minimum and maximum of every colour in one aggregate, unfolded to rows."""
    wide = rows.agg(
        *[F.min(c).alias(f"lo_{c}") for c in colours],
        *[F.max(c).alias(f"hi_{c}") for c in colours],
        *[F.count(c).alias(f"n_{c}") for c in colours],
    )
    long = wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("colour"),
            F.col(f"lo_{c}").alias("observed_min"),
            F.col(f"hi_{c}").alias("observed_max"),
            F.col(f"n_{c}").alias("finite_rows"),
            F.lit(float(absolute.get(c, 0.0))).alias("floor"),
        )
        for c in colours
    ])))
    padding = F.greatest(F.col("floor"), (F.col("observed_max") - F.col("observed_min")) * F.lit(span_fraction))
    padded = long.withColumn("padding", padding)
    return padded.select(
        "colour", "observed_min", "observed_max", "finite_rows", "padding",
        (F.col("observed_min") - F.col("padding")).alias("min"),
        (F.col("observed_max") + F.col("padding")).alias("max"),
    )


def envelope_coverage(rows: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Finite, covered and outside rows per colour, in one aggregate."""
    wide = rows.agg(
        *[F.count(c).alias(f"n_{c}") for c in bounds],
        *[F.count_if(F.col(c).between(lo, hi)).alias(f"in_{c}") for c, (lo, hi) in bounds.items()],
    )
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("colour"), F.col(f"n_{c}").alias("finite"), F.col(f"in_{c}").alias("covered"))
        for c in bounds
    ])))
    return long.withColumns(
        {"outside": F.col("finite") - F.col("covered"), "covered_fraction": F.try_divide("covered", "finite")}
    )


def rule_violations(rows: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(rule, violations) from one aggregate; a rule is a condition every row must meet."""
    wide = rows.groupBy(*by).agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return wide.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])),
    )


def rank_grain(ranks: DataFrame, by: Sequence[str], rank: str) -> DataFrame:
    """Ranks of a group must run from 1 to its size without repeats.

    Repeats are found per (group, rank), which spreads a large group over tasks.
    """
    per_rank = ranks.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("__n"))
    return per_rank.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        F.min(rank).alias("first_rank"),
        F.max(rank).alias("last_rank"),
        F.count_if(F.col("__n") > 1).alias("repeated"),
    ).withColumn("contiguous", (F.col("first_rank") == 1) & (F.col("last_rank") == F.col("n")) & (F.col("repeated") == 0))
