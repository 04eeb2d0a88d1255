"""Top lists per model, reciprocal rank fusion and eligibility-aware fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from raresift.operators.ordered import global_rank


def top_per_group(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[Column],
    limit: int,
    rank: str = "rank",
    salts: int = 32,
    salt_on: str = "source_id",
) -> DataFrame:
    """The first ``limit`` rows of each group with their exact rank.

    Groups are few and huge (models), so a group is first cut to ``limit`` rows
    in each of ``salts`` hash slices and only the survivors meet in one task:
    at most ``salts * limit`` rows per group.
    """
    sliced = df.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    inner = W.partitionBy(*by, "__salt").orderBy(*order)
    outer = W.partitionBy(*by).orderBy(*order)
    return (
        sliced.withColumn("__r", F.row_number().over(inner))
        .where(F.col("__r") <= limit)
        .drop("__r", "__salt")
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= limit)
        .withColumn(rank, F.col(rank).cast("long"))
    )


def with_top_rank(
    df: DataFrame, *, by: Sequence[str], order: Sequence[Column], limit: int, key: str = "source_id", rank: str = "rank"
) -> DataFrame:
    """All rows with their exact rank where it is at most ``limit``, else NULL; (``by``, ``key``) must be unique.

    Only the top lists are ordered, so this is for budgets: inside is ``rank <= k``, outside is NULL or more.
    """
    top = top_per_group(df, by=by, order=order, limit=limit, rank=rank, salt_on=key)
    return df.join(top.select(*by, key, rank), [*by, key], "left")


def model_ranks(scores: DataFrame, *, limit: int) -> DataFrame:
    """Top ``limit`` sources of every model by (score desc, source_id)."""
    return top_per_group(
        scores,
        by=["result_id"],
        order=[F.desc("score"), F.asc("source_id")],
        limit=limit,
        rank="model_rank",
    )


def check_ranks(ranks: DataFrame, rrf_k: float) -> None:
    """Refuse a non-positive constant or a source listed twice for a model."""
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    if not ranks.groupBy("result_id", "source_id").count().where("count > 1").isEmpty():
        raise ValueError("a source is ranked twice for one model")


def rrf_scores(ranks: DataFrame, *, rrf_k: float = 60.0) -> DataFrame:
    """Sum of 1/(k+rank) per source with its support and rank statistics."""
    return ranks.groupBy("source_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("model_rank"))), 12).alias("rrf_score"),
        F.size(F.collect_set("result_id")).cast("long").alias("model_support"),
        F.size(F.collect_set("dataset_variant")).cast("long").alias("variant_support"),
        F.size(F.collect_set("model")).cast("long").alias("estimator_support"),
        F.min("model_rank").cast("long").alias("best_model_rank"),
        F.avg("model_rank").alias("mean_model_rank"),
    )


CONSENSUS_ORDER = (
    F.desc, "rrf_score"), (F.desc, "model_support"), (F.desc, "variant_support"), (
    F.asc, "best_model_rank"), (F.asc, "source_id")
ELIGIBILITY_ORDER = (
    F.desc, "eligibility_normalized_rrf"), (F.desc, "eligible_support_fraction"), (
    F.desc, "model_support"), (F.asc, "best_model_rank"), (F.asc, "source_id")


def rrf_consensus(ranks: DataFrame, *, rrf_k: float = 60.0, validate: bool = False) -> DataFrame:
    """Fused list with a contiguous consensus rank.

    Validation costs one more pass over the ranks and is therefore optional.
    """
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    if validate:
        check_ranks(ranks, rrf_k)
    order = [direction(name) for direction, name in CONSENSUS_ORDER]
    return global_rank(rrf_scores(ranks, rrf_k=rrf_k), order=order, name="consensus_rank")


def has_bit(mask: str | Column, bit: int | Column) -> Column:
    """True when ``bit`` is set in a (possibly NULL) 64-bit mask."""
    column = F.col(mask) if isinstance(mask, str) else mask
    if isinstance(bit, int):
        value = F.lit(1 << bit if bit < 63 else -(1 << 63))
    else:
        value = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return F.coalesce(column, F.lit(0).cast("long")).bitwiseAND(value) != 0


def model_opportunities(
    sources: DataFrame, models: Sequence[dict], ranks: DataFrame, *, limit: int, rrf_k: float = 60.0
) -> DataFrame:
    """One row per (source, model) with eligibility, status, reason and contribution.

    ``models`` is the explicit selection (result_id, variant_bit): a handful of
    literals, expanded in place instead of by a join.
    """
    rows = F.array(*[
        F.struct(F.lit(m["result_id"]).alias("result_id"), F.lit(int(m["variant_bit"])).alias("variant_bit"))
        for m in models
    ])
    spread = sources.withColumn("__m", F.explode(rows)).select(
        "source_id",
        F.col("__m.result_id").alias("result_id"),
        F.col("__m.variant_bit").alias("variant_bit"),
        has_bit("locus_mask", F.col("__m.variant_bit")).alias("locus_keep"),
        has_bit("photometry_mask", F.col("__m.variant_bit")).alias("photometry_keep"),
        has_bit("astrometry_mask", F.col("__m.variant_bit")).alias("astrometry_keep"),
        has_bit("compatible_mask", F.col("__m.variant_bit")).alias("eligible"),
    )
    reason = F.when(F.col("eligible"), "passed_all_variant_filters").otherwise(
        F.concat(
            F.lit("failed_"),
            F.concat_ws(
                "+",
                F.when(~F.col("locus_keep"), "locus"),
                F.when(~F.col("photometry_keep"), "photometry_quality"),
                F.when(~F.col("astrometry_keep"), "astrometry"),
            ),
        )
    )
    ranked = F.col("model_rank").isNotNull()
    return spread.join(
        ranks.select("source_id", "result_id", "model_rank", "score"), ["source_id", "result_id"], "left"
    ).withColumns(
        {
            "model_status": F.when(ranked, f"ranked_top_{limit}")
            .when(F.col("eligible"), f"eligible_below_top_{limit}")
            .otherwise("ineligible_variant"),
            "eligibility_reason": reason,
            "rrf_contribution": F.when(ranked, F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("model_rank"))).otherwise(0.0),
        }
    )


def eligibility_consensus(consensus: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Divide the fused score by the models that could see the source, and rank again."""
    support = opportunities.groupBy("source_id").agg(
        F.count_if("eligible").alias("eligible_model_count"),
        F.count("model_rank").alias("ranked_model_count"),
    )
    enriched = consensus.join(support, "source_id", "left").withColumns(
        {
            "eligible_support_fraction": F.try_divide("ranked_model_count", "eligible_model_count"),
            "eligibility_normalized_rrf": F.try_divide("rrf_score", "eligible_model_count"),
        }
    )
    order = [direction(name) for direction, name in ELIGIBILITY_ORDER]
    return global_rank(enriched, order=order, name="eligibility_rank")


def pass_first_ranks(scored: DataFrame) -> DataFrame:
    """Rank by score, then again with accepted rows first; delta between both."""
    before = global_rank(scored, order=[F.desc("score"), F.asc("source_id")], name="rank_before")
    after = global_rank(before, order=[F.desc("passed"), F.asc("rank_before")], name="rank_after")
    return after.withColumn("rank_delta", F.col("rank_before") - F.col("rank_after"))
