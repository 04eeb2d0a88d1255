"""Entry contract, plan shapes, and oracle comparison of a fast selection.

``RARESIFT_ORACLE=all`` compares every query that has a SQL text.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = [
    "wn_01_model_top_n", "ag_05_rrf_consensus", "wn_07_pr_curve", "wn_08_roc_curve", "wn_13_select_threshold", "prj_12_disposition",
    "prj_14_spatial", "flt_04_variant_rules", "jn_03_cone_match", "jn_04_two_step_match", "jn_11_score_audit", "jn_17_variant_overlap",
    "dd_01_radius_rule", "dd_05_merge_conflicts", "loc_08_exact_union", "ag_15_band_combinations", "ag_23_population_distances",
    "tl_01_sky_grid", "tl_05_pending_tiles", "src_09_append_evolving", "sm_02_folds", "ml_01_score_pool", "str_04_progress_windows",
]


def names():
    return sorted(entry.oracle_sql()) if os.environ.get("RARESIFT_ORACLE") == "all" else FAST


@pytest.mark.parametrize("name", names())
def test_equals_duckdb(spark, name):
    problem, _ = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert problem is None


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "source_id" and df.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["loc_08_exact_union", "prj_15_mollweide", "ml_01_score_pool", "prj_13_review_note"])
def test_no_python_in_the_hot_path(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text


def test_cone_match_is_an_equi_join(spark):
    text = plan(spark, "jn_03_cone_match")
    assert "Cartesian" not in text and "BroadcastNestedLoop" not in text


def test_top_lists_limit_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "wn_01_model_top_n")


@pytest.mark.parametrize("name,scans", [("ag_15_band_combinations", 4), ("ag_14b_variant_summary", 3)])
def test_reports_read_their_rows_once(spark, name, scans):
    # The pool view itself reads the base table three times; the share denominator is one more.
    assert plan(spark, name).count("FileScan") <= scans + (2 if name.startswith("ag_15") else 0)


def test_filters_and_columns_reach_the_scan(spark, tables):
    text = tables.wise.select("source_id", "W1")._jdf.queryExecution().executedPlan().toString()
    narrow = tables.label.where("quality = 1").select("source_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in narrow
    assert "l_shipmode" not in text


def test_resumed_build_redoes_only_the_changed_tile(spark):
    rows = entry.queries()["tl_06_build_pool"](spark, SF).collect()
    assert all(r.status == "completed" for r in rows)
    assert [r.tile_id for r in rows if r.redone] == ["t3"]


def test_diverse_selection_leads_with_profile_leaders(spark):
    from raresift.operators.model_review import select_diverse

    rows = [
        ("a", "x", "s", "strict_a", "f", "P", 0.9, 0.1, 0.1, 0.1, 0.5, 0.30),
        ("b", "x", "s", "strict_a", "f", "P", 0.1, 0.9, 0.1, 0.1, 0.5, 0.29),
        ("c", "x", "s", "strict_a", "f", "P", 0.1, 0.1, 0.9, 0.1, 0.5, 0.28),
        ("d", "x", "s", "strict_a", "f", "P", 0.1, 0.1, 0.1, 0.9, 0.5, 0.27),
        ("e", "x", "s", "strict_a", "f", "P", 0.1, 0.1, 0.1, 0.1, 0.01, 0.26),
        ("f", "x", "s", "strict_a", "f", "P", 0.2, 0.2, 0.2, 0.2, 0.5, 0.95),
        ("g", "x", "s", "strict_a", "f", "P", 0.2, 0.2, 0.2, 0.2, 0.5, 0.94),
        ("h", "y", "s", "relaxed_a", "f", "P", 0.2, 0.2, 0.2, 0.2, 0.5, 0.10),
    ]
    df = spark.createDataFrame(
        rows,
        "result_id string, model string, sampler string, dataset_variant string, feature_set string, profile string, "
        "holdout_recall_at_100 double, holdout_average_precision double, holdout_precision_at_100 double, "
        "threshold_operating_score double, holdout_fpr double, ranking_score double",
    )
    got = {r.result_id: r.profile for r in select_diverse(df, top_n=7).collect()}
    assert got == {
        "a": "Recall@100 leader", "b": "AP leader", "c": "Precision@100 leader", "d": "Threshold balance",
        "e": "Lowest FPR", "f": "Global balance", "h": "P",
    }  # the unseen signature beats the better-scored near copy


def test_short_write_fails_the_build(spark, tables, monkeypatch):
    import tempfile

    from pyspark.sql import functions as F

    from raresift.plans import jobs
    from raresift.plans.locus_queries import LOCI, SCHEMA

    rows = tables.pool.where("ra < 60").withColumn("tile_id", F.concat(F.lit("t"), F.floor(F.col("ra") / 30.0).cast("string")))
    plan = rows.select("tile_id").distinct().withColumn("query_hash", F.lit("q1"))
    stage, root = jobs.StagedTable.stage, tempfile.mkdtemp(prefix="spark-")
    monkeypatch.setattr(jobs.StagedTable, "stage", lambda self, df, **more: stage(self, df.where("tile_id <> 't1' or source_id % 5 <> 0"), **more))
    build = lambda some=plan, **more: jobs.build_pool(rows, some, tables.known, LOCI, SCHEMA, root, **more)
    with pytest.raises(PermissionError):
        build()
    with pytest.raises(ValueError, match="'t1'"):
        build(confirm_full_build=True)
    table = jobs.pool_table(spark, root)
    assert table.version() == 0 and table.registry().isEmpty()
    monkeypatch.undo()
    assert {(r.tile_id, r.status) for r in build(max_tiles=1).collect()} == {("t0", "completed")}
    assert {r.status for r in build(confirm_full_build=True).collect()} == {"completed"}
    before = {r.tile_id: r["count"] for r in table.rows().groupBy("tile_id").count().collect()}
    assert before == {r.tile_id: r["count"] for r in rows.groupBy("tile_id").count().collect()}
    monkeypatch.setattr(jobs.StagedTable, "stage", lambda self, df, **more: stage(self, df.where("source_id % 5 <> 0"), **more))
    with pytest.raises(ValueError, match="t0.*t1"):
        build(plan.withColumn("query_hash", F.lit("q2")), confirm_full_build=True)
    monkeypatch.undo()
    assert before == {r.tile_id: r["count"] for r in table.rows().groupBy("tile_id").count().collect()} and table.version() == 2
    assert table.clean() == 2 and before == {r.tile_id: r["count"] for r in table.rows().groupBy("tile_id").count().collect()}
    assert jobs.finalise_pool(spark, plan, root).first().n_tiles == plan.count()
    with pytest.raises(ValueError, match="t99"):
        jobs.finalise_pool(spark, plan.unionByName(spark.sql("select 't99' tile_id, 'q1' query_hash")), root)


def test_builds_join_their_rows_once_and_judge_them_after_dealing(spark, monkeypatch, tmp_path):
    from raresift.operators import locus
    from raresift.plans import job_queries, jobs
    from raresift.plans.analogues import Tables

    judged, evaluate = [], locus.evaluate_union
    monkeypatch.setattr(locus, "evaluate_union", lambda rows, *more, **named: judged.append(rows) or evaluate(rows, *more, **named))
    job_queries.tl_06_bounded(Tables(spark, SF)).collect()
    assert len(judged) == 3
    for rows in judged:
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in text and "lineitem" not in rows.inputFiles()[0]
        assert not any("lineitem" in f for f in rows.inputFiles())


def _reads_lineitem(df):
    return any("lineitem" in f for f in df.inputFiles())


def test_landed_files_hold_a_bounded_number_of_rows(spark, tables, monkeypatch):
    from raresift.plans import stream_queries

    monkeypatch.setattr(stream_queries, "ROWS_A_FILE", 500)
    folder, each = stream_queries._land(tables, tables.core.select("source_id"), "land", tables.lineitem)
    files = spark.read.parquet(folder).inputFiles()
    assert len(files) == 3 * each and len(files) >= tables.lineitem.count() / 500


@pytest.mark.parametrize("name", ["ag_22_residual_summary", "loc_05_fit_and_annotate"])
def test_many_passes_read_settled_rows(spark, name):
    assert not _reads_lineitem(entry.queries()[name](spark, SF))


def test_rows_are_joined_once_before_tiles_are_dealt(spark, monkeypatch):
    from raresift.plans import tile_queries

    seen, write = [], tile_queries.landing.write_tiles
    monkeypatch.setattr(tile_queries.landing, "write_tiles", lambda df, path: seen.append(df) or write(df, path))
    entry.queries()["src_02_pool_views"](spark, SF)
    assert len(seen) == 1 and not _reads_lineitem(seen[0])


def test_filter_audit_judges_settled_rows(spark, monkeypatch):
    from raresift.operators import locus

    seen, compare_policies = [], locus.compare_policies
    monkeypatch.setattr(locus, "compare_policies", lambda df, *more, **named: seen.append(df) or compare_policies(df, *more, **named))
    entry.queries()["job_03_filter_audit"](spark, SF)
    assert len(seen) == 1 and not _reads_lineitem(seen[0])


@pytest.mark.parametrize("name", ["ag_14m_plane_discrepancy", "ag_14n_boundary_samples"])
def test_verdicts_are_not_repeated_in_a_filter(spark, name):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert max([len(line) for line in text.splitlines() if "Filter" in line], default=0) < 1500
