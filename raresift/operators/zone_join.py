"""Cone match of two catalogues as an equi-join on sky cells.

The sphere is cut into declination zones of ``cell`` degrees and each zone into
right-ascension cells of about the same width. A left row sits in one cell; a
right row is copied to the few cells its search circle touches (both sides of
RA 0/360, all cells of a polar cap). The join key is therefore an integer pair
and the exact separation is tested on candidates only. A crowded cell is a
skewed join partition, which AQE splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions.sky import separation_arcsec


def _cells_in_zone(zone: Column, cell: float) -> Column:
    """Number of RA cells of a zone: fewer towards the poles, at least one."""
    low = zone * F.lit(cell) - 90.0
    edge = F.least(F.greatest(F.abs(low), F.abs(low + cell)), F.lit(90.0))
    return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / F.lit(cell)), F.lit(1).cast("long"))


def cone_match(
    left: DataFrame,
    right: DataFrame,
    *,
    radius_arcsec: float,
    cell_arcsec: float | None = None,
    left_id: str = "source_id",
    sep: str = "sep_arcsec",
) -> DataFrame:
    """All (left, right) rows within ``radius_arcsec``.

    ``left`` needs ``ra``/``dec``; they are kept, and the right-hand position is
    returned as ``match_ra``/``match_dec``.
    """
    radius = radius_arcsec / 3600.0
    cell = max(4.0 * radius, (cell_arcsec or 0.0) / 3600.0)
    lhs = left.withColumn("__zone", F.floor((F.col("dec") + 90.0) / F.lit(cell)))
    n = _cells_in_zone(F.col("__zone"), cell)
    lhs = lhs.withColumn("__cell", F.floor(F.pmod(F.col("ra"), F.lit(360.0)) * n / F.lit(360.0)))

    d, r = F.col("match_dec"), F.lit(radius)
    near_pole = F.abs(d) + r >= 89.999
    spread = F.degrees(
        F.atan(
            F.lit(math.sin(math.radians(radius)))
            / F.sqrt(F.abs(F.cos(F.radians(d - r)) * F.cos(F.radians(d + r))))
        )
    )
    zones = F.sequence(
        F.floor((F.greatest(d - r, F.lit(-90.0)) + 90.0) / F.lit(cell)),
        F.floor((F.least(d + r, F.lit(90.0)) + 90.0) / F.lit(cell)),
    )
    rhs = (
        right.withColumnsRenamed({"ra": "match_ra", "dec": "match_dec"})
        .withColumn("__half", F.when(near_pole, F.lit(180.0)).otherwise(spread * 1.000001))
        .withColumn("__zone", F.explode(zones))
        .withColumn("__n", _cells_in_zone(F.col("__zone"), cell))
    )
    ra = F.pmod(F.col("match_ra"), F.lit(360.0))
    span = F.sequence(
        F.floor((ra - F.col("__half")) * F.col("__n") / F.lit(360.0)),
        F.floor((ra + F.col("__half")) * F.col("__n") / F.lit(360.0)),
    )
    touched = F.array_distinct(F.transform(span, lambda x: F.pmod(x, F.col("__n"))))
    rhs = rhs.withColumn("__cell", F.explode(touched)).drop("__half", "__n")
    pairs = lhs.join(rhs, ["__zone", "__cell"]).withColumn(
        sep, separation_arcsec(F.col("ra"), F.col("dec"), F.col("match_ra"), F.col("match_dec"))
    )
    return pairs.where(F.col(sep) <= radius_arcsec).drop("__zone", "__cell")


def nearest_match(pairs: DataFrame, *, left_id: str = "source_id", tie: str = "cat_id") -> DataFrame:
    """Per left row the closest match (ties by id) and how many matches there were."""
    payload = [c for c in pairs.columns if c not in (left_id, "ra", "dec")]
    return (
        pairs.groupBy(left_id)
        .agg(
            F.count(F.lit(1)).alias("match_count"),
            F.min_by(F.struct(*payload), F.struct("sep_arcsec", tie)).alias("best"),
        )
        .select(left_id, "match_count", "best.*")
    )


def two_step_match(
    candidates: DataFrame, catalogue: DataFrame, *, radius_arcsec: float, fallback_limit: int | None = None
) -> DataFrame:
    """Match by listed id, then by position for what is left; one row per candidate.

    ``fallback_limit`` bounds the positional step to the first candidates by id
    where the caller asks for it; by default all unmatched rows take part.
    """
    exact = (
        catalogue.where(F.col("listed_id").isNotNull())
        .groupBy(F.col("listed_id").alias("source_id"))
        .agg(F.min(F.struct("cat_id", "main_id")).alias("m"))
        .join(candidates.select("source_id"), "source_id", "left_semi")
        .select(
            "source_id",
            F.lit("exact_id").alias("match_method"),
            F.lit(1).cast("long").alias("match_count"),
            F.lit(0.0).alias("separation_arcsec"),
            F.col("m.main_id").alias("main_id"),
        )
    )
    rest = candidates.join(exact.select("source_id"), "source_id", "left_anti")
    if fallback_limit is not None:
        rest = rest.orderBy("source_id").limit(fallback_limit)
    near = nearest_match(cone_match(rest, catalogue, radius_arcsec=radius_arcsec)).select(
        "source_id",
        F.when(F.col("match_count") == 1, "position_unique").otherwise("position_ambiguous").alias("match_method"),
        "match_count",
        F.col("sep_arcsec").alias("separation_arcsec"),
        "main_id",
    )
    found = exact.unionByName(near)
    return candidates.join(found, "source_id", "left").select(
        "source_id",
        F.col("match_method").isNotNull().alias("match_found"),
        F.coalesce("match_method", F.lit("none")).alias("match_method"),
        F.coalesce("match_count", F.lit(0).cast("long")).alias("match_count"),
        "separation_arcsec",
        "main_id",
    )
