"""Positions on the sphere: rotations, projections, areas, separations, tile ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# J2000 position of the north Galactic pole and the longitude of the celestial pole.
POLE_RA, POLE_DEC, POLE_LON = 192.85948, 27.12825, 122.93192
SUN_DISTANCE_KPC = 8.122  # fixed value


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Galactic longitude in [0, 360) and latitude, both in degrees."""
    a, d = F.radians(ra - F.lit(POLE_RA)), F.radians(dec)
    sin_p, cos_p = math.sin(math.radians(POLE_DEC)), math.cos(math.radians(POLE_DEC))
    sin_b = F.sin(d) * F.lit(sin_p) + F.cos(d) * F.lit(cos_p) * F.cos(a)
    b = F.degrees(F.asin(F.greatest(F.least(sin_b, F.lit(1.0)), F.lit(-1.0))))
    turn = F.degrees(F.atan2(F.cos(d) * F.sin(a), F.sin(d) * F.lit(cos_p) - F.cos(d) * F.lit(sin_p) * F.cos(a)))
    return F.pmod(F.lit(POLE_LON) - turn, F.lit(360.0)), b


def mollweide(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area all-sky projection, longitude growing to the left.

    The auxiliary angle is found by twelve Newton steps folded over a short
    array, which keeps the iteration inside the JVM.
    """
    lam = -F.radians(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)
    phi = F.radians(F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)))
    pole = F.abs(F.abs(phi) - F.lit(math.pi / 2)) < 1e-8

    def newton(theta: Column, _: Column) -> Column:
        slope = 2.0 + 2.0 * F.cos(2.0 * theta)
        step = F.when(
            F.abs(slope) > 1e-12, (2.0 * theta + F.sin(2.0 * theta) - F.lit(math.pi) * F.sin(phi)) / slope
        ).otherwise(0.0)
        return theta - step

    theta = F.when(pole, F.signum(phi) * F.lit(math.pi / 2)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(12)), phi, newton)
    )
    return F.lit(2.0 * math.sqrt(2.0) / math.pi) * lam * F.cos(theta), F.lit(math.sqrt(2.0)) * F.sin(theta)


def with_spatial(
    df: DataFrame, *, min_over_error: float = 2.0, max_kpc: float = 15.0, sun_kpc: float = SUN_DISTANCE_KPC
) -> DataFrame:
    """Galactic and polar coordinates, and plane positions where the parallax qualifies."""
    lon, lat = galactic(F.col("ra"), F.col("dec"))
    placed = df.withColumns({"galactic_l": lon, "galactic_b": lat})
    theta, radius = F.radians("galactic_l"), F.lit(90.0) - F.col("galactic_b")
    distance = F.try_divide(F.lit(1.0), F.col("parallax"))
    usable = F.coalesce(
        (F.col("parallax") > 0)
        & (F.col("parallax_over_error") >= min_over_error)
        & (distance <= max_kpc)
        & F.col("galactic_l").isNotNull(),
        F.lit(False),
    )
    in_plane = distance * F.cos(F.radians("galactic_b"))
    return placed.withColumns(
        {
            "polar_x": radius * F.sin(theta),
            "polar_y": radius * F.cos(theta),
            "distance_kpc": F.when(usable, distance),
            "plane_x_kpc": F.when(usable, F.lit(sun_kpc) - in_plane * F.cos(theta)),
            "plane_y_kpc": F.when(usable, in_plane * F.sin(theta)),
            "distance_plotted": usable,
        }
    )


def box_area_deg2(ra_min: Column, ra_max: Column, dec_min: Column, dec_max: Column) -> Column:
    band = F.sin(F.radians(dec_max)) - F.sin(F.radians(dec_min))
    return F.abs(F.radians(ra_max - ra_min) * band) * F.lit((180.0 / math.pi) ** 2)


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation by the haversine form, stable at small angles."""
    h = F.pow(F.sin(F.radians(dec2 - dec1) / 2.0), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(
        F.sin(F.radians(ra2 - ra1) / 2.0), 2
    )
    return F.degrees(2.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))) * 3600.0


def tile_id(ra_min: Column, ra_max: Column, dec_min: Column, dec_max: Column) -> Column:
    text = F.format_string("ra%06.2f_%06.2f__dec%+06.2f_%+06.2f", ra_min, ra_max, dec_min, dec_max)
    return F.replace(text, F.lit("."), F.lit("p"))
