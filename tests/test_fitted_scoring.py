"""Scoring with stored artefacts: contract, resume, refusals; published units survive failed attempts."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from raresift.operators import fitted_scoring as fs
from raresift.sources.staged import StagedTable


class Sum:
    def __init__(self, factor):
        self.factor = factor

    def predict_proba(self, matrix):
        score = self.factor * matrix.sum(axis=1)
        return np.stack([1 - score, score], axis=1)


cloudpickle.register_pickle_by_value(__import__(Sum.__module__))
BITS = {"strict": 0, "relaxed": 3}


@pytest.fixture(scope="module")
def pool(spark):
    rows = [
        (k, f"h{k}", f"t{k % 4}", "known" if k % 10 == 9 else None, (1 if k % 2 else 0) | (8 if k % 3 else 0), k / 100.0, None if k % 7 == 0 else 0.1)
        for k in range(80)
    ]
    return spark.createDataFrame(
        rows, "source_id long, source_hash string, tile_id string, known_source_exclusion string, compatible_variant_mask long, a double, b double"
    )


def hashes(pool):
    return pool.groupBy("tile_id").agg(F.bit_xor(F.xxhash64("source_hash")).cast("string").alias("tile_hash"))


def score(pool, models, root, **more):
    return fs.score_pool(pool, hashes(pool), models, BITS, f"{root}/scores", scoring_run_id="s", pool_build_id="p", schema_sha256="x", **more)


def test_scores_counts_resume_and_refusals(spark, pool, tmp_path):
    def model(name, variant, factor, features=("a", "b"), threshold=0.4):
        path = f"{tmp_path}/{name}"
        return fs.FittedModel(name, "run", variant, BITS[variant], features, threshold, path, fs.store_artefact(spark, path, cloudpickle.dumps(Sum(factor))), "pickle")

    models = [model("m1", "strict", 1.0), model("m2", "relaxed", 0.5, ("a",))]
    assert score(pool, models, tmp_path, max_tiles=1) == 2 and score(pool, models, tmp_path) == 6 and score(pool, models, tmp_path) == 0
    table = fs.score_table(spark, f"{tmp_path}/scores")
    rows = {(r.result_id, r.source_id): r for r in table.rows().collect()}
    source = pool.collect()
    want = {("m1", r.source_id): r.a + r.b for r in source if r.compatible_variant_mask & 1 and r.known_source_exclusion is None and r.b is not None}
    want |= {("m2", r.source_id): 0.5 * r.a for r in source if r.compatible_variant_mask & 8 and r.known_source_exclusion is None}
    assert set(rows) == set(want) and all(abs(rows[k].score - v) < 1e-6 and rows[k].predicted == (v >= 0.4) for k, v in want.items())
    assert len(table.rows().columns) == 13
    for r in table.registry().collect():
        assert r.rows_variant_compatible == r.rows_scored + r.rows_missing_features and r.row_count == r.rows_scored
        assert r.rows_scored == sum(k[0] == r.result_id and rows[k].tile_id == r.tile_id for k in want)

    changed = pool.where("source_id <> 5")  # one tile holds something else now
    assert score(changed, models, tmp_path) == 2 and ("m1", 5) not in {(r.result_id, r.source_id) for r in table.rows().collect()}
    before = sorted(map(tuple, table.rows().collect()))
    with pytest.raises(ValueError, match="repeated"):
        score(changed.unionByName(changed.where("source_id = 1")).withColumn("source_hash", F.lit("z")), models, tmp_path)
    with pytest.raises(ValueError, match="not finite"):
        score(changed, [model("m3", "strict", float("inf"))], tmp_path)
    fs.store_artefact(spark, models[0].path, cloudpickle.dumps(Sum(0.9)))
    with pytest.raises(ValueError, match="artefact of m1 has changed"):
        score(changed, models, tmp_path)
    with pytest.raises(ValueError, match="another bit"):
        score(changed, [fs.FittedModel("m4", "run", "strict", 3, ("a",), 0.5, "", "")], tmp_path)
    with pytest.raises(ValueError, match="not valid"):
        score(changed, [fs.FittedModel("m4", "run", "strict", 0, ("a",), float("nan"), "", "")], tmp_path)
    assert sorted(map(tuple, table.rows().collect())) == before


def test_half_written_versions_are_passed_over(spark, tmp_path):
    table = StagedTable(spark, str(tmp_path), ["tile_id"], "status string")
    rows = spark.createDataFrame([(k, f"00{k % 3}") for k in range(30)], "source_id long, tile_id string")
    entries = lambda df: df.groupBy("tile_id").agg(F.count("*").alias("row_count")).withColumn("status", F.lit("done"))
    assert table.version() == 0 and table.measured().isEmpty()
    assert table.publish(table.stage(rows), entries(rows)) == 1
    more = spark.createDataFrame([(99, "001"), (98, "007")], "source_id long, tile_id string")
    assert table.publish(table.stage(more), entries(more)) == 2
    assert {(r.tile_id, r.measured_rows) for r in table.measured().collect()} == {("000", 10), ("001", 1), ("002", 10), ("007", 1)}
    half = spark.read.parquet(f"{tmp_path}/registry/version=2").limit(1)
    half.write.parquet(f"{tmp_path}/registry/version=3")  # says four entries, holds one
    assert table.version() == 2 and table.rows().count() == 22
    with pytest.raises(ValueError, match="twice"):
        table.publish(table.stage(more), entries(more).unionByName(entries(more)))


def test_the_pool_is_made_of_one_pass_over_its_base_rows(tables):
    """The same rows as the joined views; the base rows, written once, are read without being grouped again."""
    from raresift.plans import model_queries as mq

    settled = tables.settled("v_base")
    found = mq._pool_rows(settled)
    assert found.exceptAll(tables.sql(mq.POOL)).isEmpty() and tables.sql(mq.POOL).exceptAll(found).isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.count("Join") == 2  # the infrared rows and the labels


def test_a_pickled_model_is_sent_features_only(spark, tmp_path):
    root = str(tmp_path / "m")
    sha = fs.store_artefact(spark, root, cloudpickle.dumps(Sum(0.5)))
    model = fs.FittedModel("m", "r", "v", 0, ("a", "b"), 0.5, root, sha, "pickle")
    rows = spark.createDataFrame([(1, "x", 2.0, 4), (2, "y", 1.0, 1)], "source_id long, tile_id string, a double, b int")
    scored = fs._by_pickle(spark, model, rows)
    assert {(r["source_id"], r["tile_id"], r["score"]) for r in scored.collect()} == {(1, "x", 3.0), (2, "y", 1.0)}
    assert "MapInPandas" not in scored._jdf.queryExecution().executedPlan().toString()
