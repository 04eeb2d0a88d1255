import pytest
from pyspark.sql import functions as F

from raresift.operators import ranking
from raresift.operators.ordered import average_rank, global_rank, percentile_ranks, running_totals

RANKS = "source_id long, result_id string, dataset_variant string, model string, model_rank int, score double"


def ranks(spark):
    return spark.createDataFrame(
        [
            (1, "a", "v1", "x", 1, 0.9),
            (1, "b", "v2", "y", 2, 0.8),
            (2, "b", "v2", "y", 1, 0.9),
            (3, "a", "v1", "x", 2, 0.7),
        ],
        RANKS,
    )


def test_fusion_orders_by_score_then_support(spark):
    rows = ranking.rrf_consensus(ranks(spark), validate=True).orderBy("consensus_rank").collect()
    assert [r.source_id for r in rows] == [1, 2, 3]
    assert (rows[0].model_support, rows[0].variant_support) == (2, 2)
    assert rows[1].rrf_score == pytest.approx(1 / 61)


def test_fusion_refuses_bad_input(spark):
    doubled = ranks(spark).unionByName(ranks(spark))
    with pytest.raises(ValueError):
        ranking.rrf_consensus(doubled, validate=True)
    with pytest.raises(ValueError):
        ranking.rrf_consensus(ranks(spark), rrf_k=0)


def test_eligibility_statuses(spark):
    sources = spark.createDataFrame(
        [(1, 3, 3, 3, 3), (2, 2, 3, 3, 2), (3, 1, 3, 3, 1)],
        "source_id long, locus_mask long, photometry_mask long, astrometry_mask long, compatible_mask long",
    )
    models = [{"result_id": "a", "variant_bit": 0}, {"result_id": "b", "variant_bit": 1}]
    long = ranking.model_opportunities(sources, models, ranks(spark), limit=10)
    got = {(r.source_id, r.result_id): (r.model_status, r.eligibility_reason) for r in long.collect()}
    assert got[(1, "a")] == ("ranked_top_10", "passed_all_variant_filters")
    assert got[(2, "a")] == ("ineligible_variant", "failed_locus")
    consensus = ranking.rrf_consensus(ranks(spark))
    by_rank = ranking.eligibility_consensus(consensus, long).orderBy("eligibility_rank").collect()
    assert by_rank[0].source_id == 2  # one model could see it, and ranked it first


def test_bit_63_is_usable(spark):
    df = spark.createDataFrame([(-(1 << 63),), (1,), (None,)], "mask long")
    got = [r[0] for r in df.select(ranking.has_bit("mask", 63)).collect()]
    assert got == [True, False, False]


def test_top_lists_survive_a_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("source_id"),
        F.when(F.col("id") < 2800, "hot").otherwise("cold").alias("result_id"),
        ((F.col("id") * 7919) % 50 / 50.0).alias("score"),
    )
    got = ranking.model_ranks(df, limit=40).toPandas()
    for name, part in df.toPandas().groupby("result_id"):
        want = part.sort_values(["score", "source_id"], ascending=[False, True]).head(40)["source_id"].tolist()
        assert got[got.result_id == name].sort_values("model_rank")["source_id"].tolist() == want


def test_ranks_and_running_totals_match_pandas_with_hot_and_null_groups(spark):
    df = spark.range(4000).select(
        "id",
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, "b").alias("g"),
        (F.col("id") * 7919 % 17).alias("v"),
    )
    got = running_totals(df, by=["g"], order=[F.desc("v"), F.asc("id")], totals={"rank": F.lit(1), "total": F.col("v")}).toPandas()
    assert len(got) == 4000
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values(["v", "id"], ascending=[False, True])
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert part["total"].tolist() == part["v"].cumsum().tolist()


def test_average_rank_shares_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "id long, v double")
    got = {r.id: r.avg_rank for r in average_rank(df, "v").collect()}
    assert got == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}
    pct = {r.id: r.p for r in percentile_ranks(df, "id", {"p": ("v", True)}).collect()}
    assert pct == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0}


def test_pass_first_keeps_score_order_within_each_side(spark):
    df = spark.createDataFrame([(1, 0.9, False), (2, 0.8, True), (3, 0.7, False)], "source_id long, score double, passed boolean")
    got = {r.source_id: (r.rank_before, r.rank_after, r.rank_delta) for r in ranking.pass_first_ranks(df).collect()}
    assert got == {1: (1, 2, -1), 2: (2, 1, 1), 3: (3, 3, 0)}


def test_global_rank_of_an_empty_frame(spark):
    assert global_rank(spark.range(0), order=[F.asc("id")]).count() == 0
