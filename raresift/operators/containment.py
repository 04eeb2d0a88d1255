"""Does the wide band contain the exact ones? By the planes' lines, and by points that fill the colour box.

A wide band holds an exact one over the whole interval of its first colour if its threshold exceeds the exact threshold by the largest
distance of the two lines there, which lies at an end of the interval. Planes that are all contained need no witness; where
points are kept by an exact locus and not by the wide one, containment is disproved. No witness proves nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.functions import photometry as ph
from raresift.operators import locus, sampling
from raresift.operators.ranking import top_per_group

INDEPENDENT = ("G_BP", "G_RP", "J_H", "H_K")
#: Colours that follow from the independent ones.
DERIVED = {"BP_RP": "G_RP - G_BP", "J_K": "J_H + H_K"}
TOLERANCE = 1e-12


def signed_log(value: float) -> float:
    return math.copysign(math.log1p(abs(value)), value)


def plane_slacks(loci: Mapping[str, Sequence[locus.Band]], wide: Sequence[locus.Band], box: Mapping[str, tuple[float, float]]) -> dict[str, list[float]]:
    """For each variant the slack of its planes: what the wide threshold has left after the exact band; below zero it sticks out."""
    known = {band.name: band for band in wide}
    out = {}
    for variant, bands in loci.items():
        slacks = []
        for exact in bands:
            over, ends = known[exact.name], map(signed_log, box[exact.x])
            apart = max(abs((exact.slope - over.slope) * x + exact.intercept - over.intercept) for x in ends)
            slacks.append(over.threshold - (apart + exact.threshold))
        out[variant] = slacks
    return out


def box_points(spark: SparkSession, power: int, box: Mapping[str, tuple[float, float]]) -> DataFrame:
    """id and transformed colours of ``2 ** power`` points in the box of independent colours, those whose derived colours lie inside, too."""
    points = sampling.low_discrepancy(spark, power, {c: box[c] for c in INDEPENDENT})
    points = points.withColumns({c: F.expr(rule) for c, rule in DERIVED.items()})
    return locus.with_transformed(points.where(ph.within_bounds({c: box[c] for c in DERIVED})))


def _judged(points: DataFrame, loci: Mapping[str, Sequence[locus.Band]], wide: Sequence[locus.Band], limit: int) -> DataFrame:
    """Points with the keep rule of every locus, and rule, count and distance to the nearest line of the wide bands."""
    _, count, keep = locus.band_rules(wide, min_outlier_planes=limit)
    rules = {f"keep__{v}": locus.band_rules(bands, min_outlier_planes=limit)[2] for v, bands in loci.items()}
    counts = {f"count__{v}": locus.band_rules(bands, min_outlier_planes=limit)[1] for v, bands in loci.items()}
    distance = F.least(*[F.abs(band.margin()) for band in wide])
    return points.withColumns({**rules, **counts, "wide_keep": keep, "wide_count": count, "distance": distance})


def containment_summary(
    points: DataFrame, loci: Mapping[str, Sequence[locus.Band]], wide: Sequence[locus.Band], box: Mapping[str, tuple[float, float]],
    *, min_outlier_planes: int = 2,
) -> DataFrame:
    """One row a variant: contained planes, least slack, points kept by the exact locus and those of them the wide one drops.

    All loci are judged in one pass over the points.
    """
    judged = _judged(points, loci, wide, min_outlier_planes)
    counts = [
        agg for v in loci for agg in (
            F.count_if(F.col(f"keep__{v}")).alias(f"n__{v}"), F.count_if(F.col(f"keep__{v}") & ~F.col("wide_keep")).alias(f"d__{v}")
        )
    ]
    found = judged.agg(F.count(F.lit(1)).alias("points"), *counts)
    slacks = plane_slacks(loci, wide, box)
    rows = F.array(*[
        F.struct(
            F.lit(v).alias("variant"), F.lit(sum(s >= -TOLERANCE for s in slacks[v])).cast("long").alias("contained_planes"),
            F.lit(len(slacks[v])).cast("long").alias("planes"), F.lit(min(slacks[v])).alias("least_slack"), F.col("points").alias("points_inside"),
            F.col(f"n__{v}").alias("exact_keep"), F.col(f"d__{v}").alias("exact_not_aggregate"), (F.col(f"d__{v}") > 0).alias("disproved"),
        )
        for v in loci
    ])
    return found.select(F.inline(rows))


def containment_witnesses(
    points: DataFrame, loci: Mapping[str, Sequence[locus.Band]], wide: Sequence[locus.Band], *, min_outlier_planes: int = 2, limit: int = 20
) -> DataFrame:
    """The first ``limit`` points of each variant that its exact locus keeps and the wide one drops, with their outlying planes under
    both and their distance to the nearest wide line."""
    judged = _judged(points, loci, wide, min_outlier_planes).where("NOT wide_keep")
    offers = F.array(*[
        F.when(F.col(f"keep__{v}"), F.struct(F.lit(v).alias("variant"), F.col(f"count__{v}").alias("exact_outlier_planes"))) for v in loci
    ])
    found = judged.withColumn("offer", F.explode(offers)).where("offer IS NOT NULL").select(
        "offer.*", "id", *INDEPENDENT, *DERIVED, F.col("wide_count").alias("aggregate_outlier_planes"), F.col("distance").alias("boundary_distance")
    )
    return top_per_group(found, by=["variant"], order=[F.asc("id")], limit=limit, rank="place", salt_on="id")
