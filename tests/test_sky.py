import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.functions import sky
from raresift.operators import tiles, zone_join


def brute(a, b, radius):
    out = set()
    for i, (ra1, d1) in enumerate(a):
        for j, (ra2, d2) in enumerate(b):
            p, q = math.radians(d1), math.radians(d2)
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(ra2 - ra1) / 2) ** 2
            if math.degrees(2 * math.asin(min(1, math.sqrt(h)))) * 3600 <= radius:
                out.add((i, j))
    return out


@pytest.mark.parametrize("radius", [2.0, 40.0])
def test_cone_match_equals_brute_force_at_poles_and_wrap(spark, radius):
    rng = np.random.default_rng(3)
    base = [(0.0001, 10.0), (359.9999, 10.0), (0.0, 89.9999), (180.0, 89.9999), (90.0, -89.9998), (10.0, 0.0), (200.0, 60.0), (45.0, -90.0), (45.0, 90.0)]
    a, b = [], []
    for ra, dec in base:
        for _ in range(12):
            for side in (a, b):
                side.append((float((ra + rng.normal(0, radius / 3600 * 2)) % 360), float(np.clip(dec + rng.normal(0, radius / 3600), -90, 90))))
    b += [a[0]] * 5
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "source_id long, ra double, dec double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "cat_id long, ra double, dec double")
    pairs = [(r.source_id, r.cat_id) for r in zone_join.cone_match(left, right, radius_arcsec=radius).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(a, b, radius)


def test_mollweide_satisfies_its_equation(spark):
    rows = [(float(l), float(b)) for l in range(0, 360, 30) for b in (-90, -60, -10, 0, 35, 89, 90)]
    df = spark.createDataFrame(rows, "l double, b double")
    x, y = sky.mollweide(F.col("l"), F.col("b"))
    for l, b, px, py in df.select("l", "b", x, y).collect():
        theta = math.asin(max(-1, min(1, py / math.sqrt(2))))
        assert 2 * theta + math.sin(2 * theta) == pytest.approx(math.pi * math.sin(math.radians(b)), abs=1e-6)
        wrapped = (l + 180) % 360 - 180
        assert px == pytest.approx(-2 * math.sqrt(2) / math.pi * math.radians(wrapped) * math.cos(theta), abs=1e-6)


def test_galactic_pole_and_centre(spark):
    df = spark.createDataFrame([(192.85948, 27.12825), (266.405, -28.936)], "ra double, dec double")
    l, b = sky.galactic(F.col("ra"), F.col("dec"))
    pole, centre = df.select(l.alias("l"), b.alias("b")).collect()
    assert pole.b == pytest.approx(90, abs=1e-3)
    assert centre.b == pytest.approx(0, abs=0.01) and min(centre.l, 360 - centre.l) < 0.01


def test_grid_covers_the_sky_once(spark):
    grid = tiles.sky_grid(spark, 70.0, 50.0)
    area = sky.box_area_deg2(*[F.col(c) for c in tiles.BOX])
    row = grid.agg(F.sum(area).alias("area"), F.count_distinct("tile_id").alias("ids"), F.count(F.lit(1)).alias("n")).first()
    assert row.area == pytest.approx(4 * math.pi * (180 / math.pi) ** 2) and row.ids == row.n == 24
    assert tiles.invalid_tiles(grid).isEmpty()
    points = spark.createDataFrame([(0.0, -90.0), (359.9, 89.9), (70.0, 10.0)], "ra double, dec double")
    assert tiles.assign_tiles(points, 70.0, 50.0).join(grid, "tile_id", "left_anti").isEmpty()


def test_children_replace_their_parent(spark):
    grid = tiles.sky_grid(spark, 180.0, 90.0)
    parent = grid.orderBy("tile_id").limit(1).select("tile_id")
    out = tiles.with_children(grid, parent, 90.0, 45.0)
    assert out.count() == 3 + 4 and out.join(parent, "tile_id", "left_semi").isEmpty()


def test_build_status_needs_equal_sets(spark):
    tile = lambda rows: spark.createDataFrame(rows, "tile_id string, status string")
    done = tile([("a", "completed"), ("b", "completed")])
    assert tiles.build_status(done, done).first().status == "completed"
    assert tiles.build_status(done, tile([("a", "completed")])).first().status == "partial"
    assert tiles.build_status(done, done.unionByName(tile([("c", "completed")]))).first().status == "partial"
