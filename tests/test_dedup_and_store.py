import json
import tempfile

import pytest
from pyspark.sql import functions as F

from raresift.operators import counterparts, dedup
from raresift.sources import landing, store


def test_radius_rule(spark):
    df = spark.createDataFrame(
        [(1, 3.0, "only"), (2, 1.2, "best"), (2, 1.9, "far"), (3, 0.4, "x"), (3, 0.6, "y")],
        "source_id long, sep_arcsec double, value string",
    )
    resolved = dedup.resolve_by_radius(df, primary=1.5, secondary=1.0)
    kept = {r.source_id: r.value for r in dedup.radius_kept(resolved).collect()}
    assert kept == {1: "only", 2: "best"}
    stats = dedup.radius_stats(resolved).first()
    assert (stats.n_input, stats.n_resolved_at_primary, stats.n_dropped_ambiguous) == (5, 1, 1)


def test_secondary_radius_and_out_of_reach(spark):
    df = spark.createDataFrame(
        [(1, 0.9, "in"), (1, 1.4, "out"), (2, 2.0, "a"), (2, 3.0, "b")], "source_id long, sep_arcsec double, value string"
    )
    resolved = {r.source_id: r.resolution for r in dedup.resolve_by_radius(df, primary=1.5, secondary=1.0).collect()}
    assert resolved == {1: "secondary", 2: "ambiguous"}


def test_counterpart_choice_and_alternatives(spark):
    rows = [(1, "t1_other", "BAA", 1.0, 2.0, 3.0, 0.1, 0.1, 0.1), (1, "t1_better", "AAA", 1.0, 2.0, 3.0, 0.2, 0.2, 0.2), (2, "t2", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "source_id long, tmass_id string, tmass_quality string, J double, H double, Ks double, J_error double, H_error double, Ks_error double")
    got = {r.source_id: (r.tmass_id, r.tmass_candidate_count) for r in counterparts.best_counterpart(df).collect()}
    assert got == {1: ("t1_better", 2), 2: ("t2", 1)}
    assert counterparts.alternative_rows(df).count() == 2
    (only,) = counterparts.alternatives_json(df).collect()
    assert "t1_better" in only.tmass_alternatives_json and "t1_other" in only.tmass_alternatives_json
    many = spark.range(1500).selectExpr("9L source_id", "concat('t', id) tmass_id", "'AAA' tmass_quality", *[
        f"cast(id AS double) {c}" for c in ("J", "H", "Ks", "J_error", "H_error", "Ks_error")])
    (large,) = counterparts.alternatives_json(many).collect()
    assert len(json.loads(large.tmass_alternatives_json)) == 1500


def test_hot_key_keeps_one_row(spark):
    df = spark.range(5000).select(F.lit(7).alias("k"), ((F.col("id") * 31) % 4999).alias("o"), "id")
    assert dedup.first_per_key(df, ["k"], ["o"]).first().o == 0
    assert dedup.last_per_key(df, ["k"], ["o"]).first().o == 4998


def test_merge_is_idempotent_and_reports_conflicts(spark):
    df = spark.createDataFrame([("b", "t", 1, "h1"), ("b", "t", 2, "h2")], "build string, tile string, source_id long, h string")
    keys = ["build", "tile", "source_id"]
    merged, conflicts = dedup.merge_by_key(df, df, keys, checksum="h")
    assert merged.count() == 2 and conflicts.isEmpty()
    _, conflicts = dedup.merge_by_key(df, df.withColumn("h", F.lit("other")), keys, checksum="h")
    assert conflicts.count() == 2


def test_append_evolves_types(spark):
    old = spark.createDataFrame([("a", 1, None, "1")], "id string, n int, empty int, x_sha256 string")
    new = spark.createDataFrame([("b", 1.5, "text", 7, True)], "id string, n double, empty string, x_sha256 int, fresh boolean")
    out = store.append_by_name(old, new)
    assert dict(out.dtypes) == {"id": "string", "n": "double", "empty": "string", "x_sha256": "string", "fresh": "boolean"}
    got = {r.id: (r.n, r.empty, r.x_sha256, r.fresh) for r in out.collect()}
    assert got == {"a": (1.0, None, "1", None), "b": (1.5, "text", "7", True)}


def test_runs_are_refused_or_replaced(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/runs"
    df = spark.createDataFrame([("r1", 1), ("r1", 2)], "run_id string, n int")
    store.register_run(df, path, "r1")
    with pytest.raises(ValueError):
        store.register_run(df, path, "r1")
    store.register_run(df.limit(1), path, "r1", replace=True)
    assert spark.read.parquet(path).count() == 1


def test_placeholder_and_absent_tables(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    store.replace_tables({"nothing": spark.range(1).select()}, root)
    assert spark.read.parquet(f"{root}/nothing").columns == ["_empty_placeholder"]
    schema = spark.range(0).schema
    assert store.read_or_empty(spark, f"{root}/absent", schema).count() == 0


def test_snapshots_are_content_addressed(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    a = store.write_snapshot(spark.range(100), root)
    b = store.write_snapshot(spark.range(100).orderBy(F.desc("id")).repartition(3), root)
    c = store.write_snapshot(spark.range(101), root)
    assert a == b != c


def test_dense_tile_is_written_whole(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/tiles"
    df = spark.range(4000).select(F.col("id").alias("source_id"), F.when(F.col("id") < 3500, "dense").otherwise(F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))).alias("tile_id"))
    landing.write_tiles(df, path)
    landing.write_tiles(df.where("tile_id = 'dense'"), path)  # replaces only its own tile
    assert landing.write_check(df, landing.written_counts(spark, path)).where("not write_ok").isEmpty()
