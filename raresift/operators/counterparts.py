"""Choice of one survey counterpart per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from raresift.functions.photometry import letter_count

ALTERNATIVE_FIELDS = ("tmass_id", "tmass_quality", "J", "H", "Ks", "J_error", "H_error", "Ks_error")
SELECTION_RULE = "most_ab_bands,most_a_bands,least_error_sum,id"


def best_counterpart(raw: DataFrame) -> DataFrame:
    """Most good bands, then best bands, then least total error, then id.

    Winner and candidate count come from one combining aggregate, so a source
    with very many candidates never meets in one task.
    """
    payload = [c for c in raw.columns if c != "source_id"]
    errors = sum(F.coalesce(F.col(c), F.lit(float("inf"))) for c in ("J_error", "H_error", "Ks_error"))
    order = F.struct(
        (-letter_count("tmass_quality", "AB")).alias("ab"),
        (-letter_count("tmass_quality", "A")).alias("a"),
        errors.alias("err"),
        F.coalesce("tmass_id", F.lit("")).alias("id"),
        F.struct(*payload).alias("row"),
    )
    grouped = raw.groupBy("source_id").agg(
        F.min(order).alias("best"), F.count(F.lit(1)).alias("tmass_candidate_count")
    )
    return grouped.select(
        "source_id", F.col("best.row.*"), "tmass_candidate_count", F.lit(SELECTION_RULE).alias("tmass_selection_rule")
    )


def alternative_rows(raw: DataFrame) -> DataFrame:
    """Every candidate of the sources that have more than one, as plain rows."""
    multiple = raw.groupBy("source_id").count().where("count > 1").select("source_id")
    return raw.join(multiple, "source_id", "left_semi").select("source_id", *ALTERNATIVE_FIELDS)


def alternatives_json(raw: DataFrame) -> DataFrame:
    """All candidates of every source with more than one, as one JSON text per source.

    The cell grows with the source's own candidates; :func:`alternative_rows`
    holds the same candidates as plain rows, for sources that are too crowded
    for one cell.
    """
    return (
        alternative_rows(raw)
        .groupBy("source_id")
        .agg(F.to_json(F.sort_array(F.collect_list(F.struct(*ALTERNATIVE_FIELDS)))).alias("tmass_alternatives_json"))
    )
