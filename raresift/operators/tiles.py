"""Sky tiling, resumable tile state and build contracts.

Tile state is an append-only event table; the current state of a tile is an
aggregate over its events, so nothing is ever updated in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresift.functions.photometry import any_true
from raresift.functions.sky import tile_id

BOX = ("ra_min", "ra_max", "dec_min", "dec_max")


def _split(df: DataFrame, ra_step: float, dec_step: float) -> DataFrame:
    """Cut every box into cells of the given steps, clipped at the box edge."""
    c = F.col
    ra_n = F.ceil((c("ra_max") - c("ra_min")) / F.lit(ra_step)).cast("int")
    dec_n = F.ceil((c("dec_max") - c("dec_min")) / F.lit(dec_step)).cast("int")
    cells = (
        df.withColumn("__i", F.explode(F.sequence(F.lit(0), ra_n - 1)))
        .withColumn("__j", F.explode(F.sequence(F.lit(0), dec_n - 1)))
    )
    box = {
        "__r0": c("ra_min") + c("__i") * F.lit(ra_step),
        "__r1": F.least(c("ra_min") + (c("__i") + 1) * F.lit(ra_step), c("ra_max")),
        "__d0": c("dec_min") + c("__j") * F.lit(dec_step),
        "__d1": F.least(c("dec_min") + (c("__j") + 1) * F.lit(dec_step), c("dec_max")),
    }
    keep = [x for x in df.columns if x not in (*BOX, "tile_id")]
    return cells.withColumns(box).select(
        *keep,
        tile_id(c("__r0"), c("__r1"), c("__d0"), c("__d1")).alias("tile_id"),
        c("__r0").alias("ra_min"), c("__r1").alias("ra_max"), c("__d0").alias("dec_min"), c("__d1").alias("dec_max"),
    )


def sky_grid(spark: SparkSession, ra_step: float, dec_step: float) -> DataFrame:
    """Regular grid over the whole sky, the last row and column clipped."""
    sky = spark.range(1).select(
        F.lit("sky").alias("tile_id"), F.lit(0.0).alias("ra_min"), F.lit(360.0).alias("ra_max"),
        F.lit(-90.0).alias("dec_min"), F.lit(90.0).alias("dec_max"),
    )
    return _split(sky, ra_step, dec_step)


def with_children(tiles: DataFrame, parents: DataFrame, ra_step: float, dec_step: float) -> DataFrame:
    """Replace the named parents by their children."""
    whole = tiles.join(parents, "tile_id", "left_anti").withColumn("parent_id", F.lit(None).cast("string"))
    split = tiles.join(parents, "tile_id", "left_semi").withColumn("parent_id", F.col("tile_id"))
    return whole.unionByName(_split(split, ra_step, dec_step))


def invalid_tiles(tiles: DataFrame) -> DataFrame:
    """Boxes out of range and repeated ids; a plan with any row here is refused."""
    c = F.col
    good = (c("ra_min") >= 0) & (c("ra_min") < c("ra_max")) & (c("ra_max") <= 360)
    good = good & (c("dec_min") >= -90) & (c("dec_min") < c("dec_max")) & (c("dec_max") <= 90)
    bad_box = tiles.where(~good).select("tile_id", F.lit("bounds").alias("problem"))
    repeated = tiles.groupBy("tile_id").count().where("count > 1").select("tile_id", F.lit("repeated").alias("problem"))
    return bad_box.unionByName(repeated)


def assign_tiles(sources: DataFrame, ra_step: float, dec_step: float) -> DataFrame:
    """Grid tile of each source by arithmetic: no join with the tile table."""
    c = F.col
    r0 = F.floor(c("ra") / F.lit(ra_step)) * F.lit(ra_step)
    d0 = F.floor((c("dec") + 90.0) / F.lit(dec_step)) * F.lit(dec_step) - 90.0
    r1, d1 = F.least(r0 + ra_step, F.lit(360.0)), F.least(d0 + dec_step, F.lit(90.0))
    return sources.withColumn("tile_id", tile_id(r0, r1, d0, d1))


def subdivide_failed(tiles: DataFrame, ra_step: float, dec_step: float) -> DataFrame:
    """Large failed tiles become skipped parents with pending children; existing ids stay as they are."""
    c = F.col
    failed = (c("status") == "failed") & (c("ra_max") - c("ra_min") > ra_step) & (c("dec_max") - c("dec_min") > dec_step)
    base = tiles.select("tile_id", *BOX, "status").withColumn("note", F.lit(None).cast("string"))
    children = (
        _split(base.where(failed).withColumn("note", F.concat(F.lit("subtile_of:"), "tile_id")), ra_step, dec_step)
        .withColumn("status", F.lit("pending"))
        .join(base.select("tile_id"), "tile_id", "left_anti")
    )
    parents = base.withColumns(
        {
            "status": F.when(failed, "skipped").otherwise(c("status")),
            "note": F.when(failed, "subdivided_into_subtiles").otherwise(c("note")),
        }
    )
    return parents.unionByName(children)


def reset_stale(state: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Running tiles without an update for ``minutes`` become failed."""
    cutoff = now - F.make_dt_interval(mins=F.lit(minutes))
    stale = (F.col("status") == "running") & (F.col("updated_at") < cutoff)
    return state.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "error_message": F.when(stale, "stale_running_reset"),
        }
    )


def current_state(log: DataFrame, payload: Sequence[str], *, key: str = "tile_id") -> DataFrame:
    """Latest event of every tile; equal times are settled by the event id."""
    return log.groupBy(key).agg(
        F.max(F.struct("ts", "event_id", *payload)).alias("last"), F.count(F.lit(1)).alias("n_events")
    ).select(key, F.col("last.ts").alias("updated_at"), *[F.col(f"last.{c}") for c in payload], "n_events")


def pending_tiles(plan: DataFrame, manifests: DataFrame, contract: Sequence[str], measured: DataFrame) -> DataFrame:
    """Planned tiles whose manifest is absent, incomplete, differs in the contract or miscounts its rows."""
    m = manifests.select("tile_id", "status", "row_count", *[F.col(c).alias(f"__{c}") for c in contract])
    joined = plan.join(m, "tile_id", "left").join(measured, "tile_id", "left")
    reasons = [
        ("absent", F.col("status").isNull()),
        ("incomplete", F.col("status") != "completed"),
        *[(f"{c}_changed", ~F.col(c).eqNullSafe(F.col(f"__{c}"))) for c in contract],
        ("row_count", ~F.col("row_count").eqNullSafe(F.coalesce("measured_rows", F.lit(0)))),
    ]
    hit = any_true([F.coalesce(rule, F.lit(False)) for _, rule in reasons])
    first = F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in reasons])
    return joined.where(hit).select("tile_id", first.alias("reason"))


def build_status(expected: DataFrame, registered: DataFrame) -> DataFrame:
    """Completed only when expected, registered and completed tiles are the same set."""
    e = expected.select("tile_id", F.lit(True).alias("expected"))
    joined = e.join(registered.select("tile_id", "status"), "tile_id", "full_outer")
    done = F.col("status") == "completed"
    counts = joined.agg(
        F.count("expected").alias("expected_tiles"),
        F.count("status").alias("registered_tiles"),
        F.count_if(done).alias("completed_tiles"),
        F.count_if(F.col("expected").isNull() | F.col("status").isNull() | ~done).alias("differences"),
    )
    return counts.withColumn(
        "status", F.when((F.col("differences") == 0) & (F.col("expected_tiles") > 0), "completed").otherwise("partial")
    )


def backfill_status(builds: DataFrame, tiles: DataFrame, expected_tiles: int | None) -> DataFrame:
    """Give old builds a status from their tiles; without an expected number none is promoted."""
    derived = tiles.groupBy("pool_build_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "completed").alias("done")
    )
    have = builds if "status" in builds.columns else builds.withColumn("status", F.lit(None).cast("string"))
    whole = F.lit(False) if expected_tiles is None else (F.col("n") == expected_tiles) & (F.col("done") == expected_tiles)
    value = F.coalesce(F.col("status"), F.when(F.coalesce(whole, F.lit(False)), "completed").otherwise("partial"))
    return have.join(derived, "pool_build_id", "left").withColumn("status", value).select(*have.columns)


def contract_violations(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields on which the same id carries different contract values."""
    left = stored.select(key, *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    joined = incoming.join(left, key, "inner")
    rows = F.array(*[
        F.when(
            ~F.col(f).cast("string").eqNullSafe(F.col(f"__{f}")),
            F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("stored"), F.col(f).cast("string").alias("incoming")),
        )
        for f in fields
    ])
    return joined.select(key, F.explode(rows).alias("v")).where("v is not null").select(key, "v.*")


def reconcile(left: DataFrame, right: DataFrame, by: Sequence[str], key: str = "source_id") -> DataFrame:
    """Sizes of A-B, B-A, intersection and union per group, with Jaccard."""
    keys = [*by, key]
    sides = (
        left.select(*keys, F.lit(1).alias("side")).unionByName(right.select(*keys, F.lit(2).alias("side")))
        .groupBy(*keys)
        .agg(F.bit_or("side").alias("sides"))
    )
    counts = sides.groupBy(*by).agg(
        F.count_if(F.col("sides") == 1).alias("only_left"),
        F.count_if(F.col("sides") == 2).alias("only_right"),
        F.count_if(F.col("sides") == 3).alias("shared"),
        F.count(F.lit(1)).alias("either"),
    )
    return counts.withColumn("jaccard", F.try_divide("shared", "either"))


def budget_status(tiles: DataFrame, max_bytes: int, order: Sequence[str]) -> DataFrame:
    """Pending tiles are skipped once the bytes used by the tiles before them reach the budget.

    The running total is a distributed scan, so a registry of any length works.
    """
    from raresift.operators.ordered import running_totals

    used = running_totals(
        tiles, order=[F.col(c) for c in order], totals={"used_bytes": F.col("bytes")}
    ).withColumn("used_before", F.col("used_bytes") - F.col("bytes"))
    over = (F.col("status") == "pending") & (F.col("used_before") >= max_bytes)
    return used.withColumns(
        {"status": F.when(over, "skipped").otherwise(F.col("status")), "note": F.when(over, "byte_budget_reached")}
    )
