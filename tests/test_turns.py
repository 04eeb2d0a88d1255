"""Tables that are written in turns, so that the disk never holds the shuffles of all their rows."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from raresift import session
from raresift.plans import analogues, stream_queries
from raresift.sources.staged import StagedTable

SF = "/root/testdata/sf0.001"


def same(one, two):
    return one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_landed_pool_is_the_view(spark, tmp_path, monkeypatch):
    """Also with missing keys, repeated lines, and line numbers that let keys share a source number."""
    monkeypatch.setattr(session, "ROWS_A_TURN", 2000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumns({
        "l_linenumber": F.expr("cast(case when l_partkey % 5 = 0 then l_linenumber + 10 when l_partkey % 7 = 0 then null else l_linenumber end as int)"),
        "l_orderkey": F.expr("case when l_suppkey % 6 = 0 then null else l_orderkey end"),
        "l_discount": F.expr("case when l_partkey % 13 = 0 then null else l_discount end"),
        "l_tax": F.expr("case when l_partkey % 17 = 0 then double('NaN') else l_tax end"),
    })
    lines.unionByName(lines.limit(300)).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = analogues.Tables(spark, str(tmp_path))
    pool = tables.pool.cache()
    shared = pool.where("source_id is not null").groupBy("source_id").count().where("count > 1")
    assert not shared.isEmpty() and not pool.where("source_id is null").isEmpty()
    assert same(tables.landed_pool(), pool)


def test_lines_are_shuffled_once(spark, monkeypatch):
    seen, settle = [], analogues.settle
    monkeypatch.setattr(analogues, "settle", lambda df, **more: seen.append((df, more)) or settle(df, **more))
    monkeypatch.setattr(session, "ROWS_A_TURN", 2000)
    pool = analogues.Tables(spark, SF).landed_pool()
    (lines, how), = seen
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and how["turns"] == 3
    assert not any("lineitem" in f for f in pool.inputFiles())


def test_builds_deal_their_rows_in_turns(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TURN", 2000)
    stage, turns = StagedTable.stage, []
    monkeypatch.setattr(StagedTable, "stage", lambda self, rows, **more: turns.append(more.get("turns")) or stage(self, rows, **more))
    before = spark.conf.get(session._CLEANUP)
    rows = {r.tile_id: r for r in entry.queries()["tl_06_build_pool"](spark, SF).collect()}
    whole = analogues.Tables(spark, SF).pool.groupBy(F.concat(F.lit("t"), F.floor(F.col("ra") / 30.0).cast("string")).alias("tile")).count().collect()
    assert {r.tile: r["count"] for r in whole} == {k: r.row_count for k, r in rows.items()}
    assert turns == [3, 1] and spark.conf.get(session._CLEANUP) == before  # the second call redoes one tile


def test_landed_batches_are_dealt_one_at_a_time(spark, tables, monkeypatch):
    settled, settle = [], session.settle
    monkeypatch.setattr(stream_queries, "settle", lambda df: settled.append(settle(df)) or settled[-1])
    core = tables.core.select("source_id", "G")
    folder, each = stream_queries._land(tables, core, "land", tables.lineitem)
    landed = spark.read.parquet(folder)
    assert len(settled) == 1 and len(landed.inputFiles()) == 3 * each and same(landed, core)
