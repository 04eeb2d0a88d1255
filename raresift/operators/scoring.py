"""Scoring a pool with several models in one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions.photometry import all_true
from raresift.operators.ranking import has_bit


@dataclass(frozen=True)
class LinearModel:
    """A logistic model whose score is a plain expression."""

    result_id: str
    variant_bit: int
    threshold: float
    intercept: float
    weights: Mapping[str, float] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for name, w in self.weights.items():
            z = z + F.lit(w) * F.col(name)
        return 1.0 / (1.0 + F.exp(-z))


def eligible_rows(pool: DataFrame, models: Sequence[LinearModel], *, mask: str = "compatible_mask") -> DataFrame:
    """One row per (source, model) allowed by its bit, with the double score or NULL when a feature is missing."""
    offers = F.array(*[
        F.when(
            has_bit(mask, m.variant_bit),
            F.struct(
                F.lit(m.result_id).alias("result_id"),
                F.lit(m.threshold).alias("threshold"),
                F.when(all_true([F.col(f).isNotNull() for f in m.features]), m.score()).alias("raw"),
            ),
        )
        for m in models
    ])
    spread = pool.where(F.col("known").isNull()).withColumn("__o", F.explode(offers)).where("__o is not null")
    return spread.select("source_id", "tile_id", "__o.*")


def score_rows(offers: DataFrame) -> DataFrame:
    """Scored rows: the threshold is applied to the double, the score is stored as float32."""
    return offers.where(F.col("raw").isNotNull()).select(
        "result_id", "tile_id", "source_id", F.col("raw").cast("float").alias("score"),
        (F.col("raw") >= F.col("threshold")).cast("int").alias("predicted"), "threshold",
    )


def scoring_counts(offers: DataFrame, by: Sequence[str] = ("result_id",)) -> DataFrame:
    """Compatible, missing, scored and positive rows; compatible = scored + missing by construction."""
    ok = F.col("raw").isNotNull()
    return offers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_variant_compatible"),
        F.count_if(~ok).alias("rows_missing_features"),
        F.count_if(ok).alias("rows_scored"),
        F.count_if(ok & (F.col("raw") >= F.col("threshold"))).alias("rows_predicted_positive"),
        F.count_if(ok & F.isnan("raw")).alias("non_finite"),
    )


def write_scores(scored: DataFrame, path: str) -> None:
    """Partitioned by model and tile; range partitioning cuts a dense tile over several tasks."""
    (
        scored.repartitionByRange("result_id", "tile_id", F.xxhash64("source_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("result_id", "tile_id")
        .parquet(path)
    )


def model_contract(selected: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Requested models in order with the stored fields that disagree; an absent model is a violation too."""
    right = stored.select("result_id", F.lit(True).alias("__have"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = selected.join(right, "result_id", "left")
    bad = F.concat_ws(
        ",",
        F.when(F.col("__have").isNull(), "absent"),
        *[F.when(F.col("__have").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields],
    )
    return joined.select("result_id", "place", bad.alias("violations"))
