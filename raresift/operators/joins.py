"""Relational joins of the pipeline.

No join forces a broadcast of a side whose size depends on the data: Spark
picks broadcast from its size statistics and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions.photometry import LOCAL_COLOURS, all_true, any_true, with_colours, within_bounds
from raresift.functions.text import subtype_by_substring
from raresift.operators.ranking import has_bit


def feature_frame(labels: DataFrame, core: DataFrame, infrared: DataFrame, wise: DataFrame, sample: str) -> DataFrame:
    """Labelled sources with optical rows, infrared detections where present, and colours."""
    joined = (
        labels.join(core, "source_id", "inner").join(infrared, "source_id", "left").join(wise, "source_id", "left")
    )
    return with_colours(joined).withColumn("sample_label", F.lit(sample))


def acquire(
    core: DataFrame,
    neighbours: Sequence[DataFrame],
    optional: DataFrame | None,
    *,
    box: Mapping[str, tuple[float, float]],
    not_null: Sequence[str],
    bounds: Mapping[str, tuple[float, float]],
    limit: int | None = None,
) -> DataFrame:
    """Sky box and non-NULL filters first (they reach the scan), joins, then colour bounds."""
    rules = [(F.col(c) >= lo) & (F.col(c) < hi) for c, (lo, hi) in box.items()]
    out = core.where(all_true(rules))
    for survey in neighbours:
        out = out.join(survey, "source_id", "inner")
    if optional is not None:
        out = out.join(optional, "source_id", "left")
    out = out.where(all_true([F.col(c).isNotNull() for c in not_null]))
    out = with_colours(out, LOCAL_COLOURS, keep_existing=True).where(within_bounds(bounds))
    return out.orderBy("source_id").limit(limit) if limit else out


def label_map(known: DataFrame, *, last_wins: bool = False) -> DataFrame:
    """One label per id by priority; the two exclusion paths differ in who wins."""
    pick = F.max_by if last_wins else F.min_by
    return known.groupBy("source_id").agg(pick("label", "prio").alias("label"))


def exclude_known(df: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log of excluded rows with their label, surviving rows)."""
    return df.join(labels, "source_id", "inner"), df.join(labels, "source_id", "left_anti")


def case_rows(
    predictions: DataFrame, positive_ids: DataFrame, negative_ids: DataFrame, photometry: DataFrame
) -> DataFrame:
    """Predictions with identity, photometry, colours and a display name by precedence."""
    wr = positive_ids.groupBy("source_id").agg(
        F.min("wr_number").alias("wr_number"), F.min("spectral_type").alias("spectral_type")
    )
    other = negative_ids.groupBy("source_id").agg(
        F.min("main_id").alias("main_id"), F.min("main_type").alias("main_type")
    )
    joined = (
        predictions.join(wr, "source_id", "left").join(other, "source_id", "left").join(photometry, "source_id", "left")
    )
    positive = F.col("target") == 1
    return with_colours(joined, ("G_BP", "G_RP", "BP_RP")).withColumns(
        {
            "subtype": F.when(positive, subtype_by_substring(F.col("spectral_type"))),
            "object_name": F.coalesce(
                F.when(positive, F.concat(F.lit("WR "), F.col("wr_number"))),
                F.col("main_id"),
                F.concat(F.lit("Gaia DR3 "), F.col("source_id").cast("string")),
            ),
        }
    )


def grain_check(result: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """Row and distinct counts of a lookup next to those of its id list; all four must agree."""
    got = result.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"))
    want = ids.agg(F.count(F.lit(1)).alias("ids"), F.count_distinct(key).alias("distinct_ids"))
    both = got.join(F.broadcast(want))  # one row each
    return both.withColumn(
        "grain_kept",
        (F.col("rows") == F.col("ids")) & (F.col("keys") == F.col("ids")) & (F.col("ids") == F.col("distinct_ids")),
    )


def bad_scores(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """Score rows whose source is missing, changed, known, ineligible or lacks the model's bit.

    ``<>`` with NULL is not true, so a row without a stored hash is not a conflict.
    """
    joined = scores.join(sources, "source_id", "left")
    missing = F.col("compatible_mask").isNull()
    reasons = [
        ("source_missing", missing),
        ("hash_changed", F.col("source_hash") != F.col("scored_hash")),
        ("known_source", F.col("known").isNotNull()),
        ("not_eligible", ~missing & (F.col("compatible_mask") == 0)),
        ("bit_off", ~missing & ~has_bit("compatible_mask", F.col("variant_bit"))),
    ]
    bad = any_true([F.coalesce(rule, F.lit(False)) for _, rule in reasons])
    return joined.where(bad).select(
        "result_id",
        "source_id",
        F.concat_ws("|", *[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in reasons]).alias("reasons"),
    )


def widen_models(long: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(source, model) rows to one row per source with the model's columns prefixed by its key."""
    wide = long.groupBy("source_id").pivot("result_id", list(keys)).agg(*[F.max(v).alias(v) for v in values])
    return wide


def export_rules(long: DataFrame) -> DataFrame:
    """Eligible rows need a score, ineligible rows must not carry one."""
    return long.agg(
        F.count_if(F.col("eligible") & F.col("score").isNull()).alias("eligible_without_score"),
        F.count_if(~F.col("eligible") & F.col("score").isNotNull()).alias("ineligible_with_score"),
    )


def pairwise_overlap(membership: DataFrame, bits: Mapping[str, int], mask: str = "mask") -> DataFrame:
    """Intersection, union, Jaccard and retention of all ordered pairs of sets.

    Members are first counted per distinct mask (map-side combined), so the
    pairs are formed over mask values and not over members.
    """
    counts = membership.groupBy(mask).agg(F.count(F.lit(1)).alias("members"))
    pairs = F.array(*[
        F.struct(
            F.lit(a).alias("left_set"), F.lit(b).alias("right_set"), F.lit(1 << i).alias("lb"), F.lit(1 << j).alias("rb")
        )
        for a, i in bits.items()
        for b, j in bits.items()
    ])
    spread = counts.select(mask, "members", F.inline(pairs))
    left = F.col(mask).bitwiseAND(F.col("lb")) != 0
    right = F.col(mask).bitwiseAND(F.col("rb")) != 0
    sized = spread.groupBy("left_set", "right_set").agg(
        F.coalesce(F.sum(F.when(left & right, F.col("members"))), F.lit(0)).alias("intersection"),
        F.coalesce(F.sum(F.when(left | right, F.col("members"))), F.lit(0)).alias("union"),
        F.coalesce(F.sum(F.when(left, F.col("members"))), F.lit(0)).alias("left_size"),
    )
    return sized.select(
        "left_set",
        "right_set",
        "intersection",
        "union",
        F.try_divide("intersection", "union").alias("jaccard"),
        F.try_divide("intersection", "left_size").alias("left_retained"),
    )


def membership_mask(rows: DataFrame, bits: Mapping[str, int], key: str = "source_id", member: str = "result_id"):
    """One mask per key with the bit of every set the key belongs to."""
    value = F.create_map(*[x for name, b in bits.items() for x in (F.lit(name), F.lit(1 << b).cast("long"))])
    return rows.groupBy(key).agg(F.bit_or(value[F.col(member)]).alias("mask"))


def run_overview(runs: DataFrame, results: DataFrame, metrics: Sequence[str], extra_runs: DataFrame) -> DataFrame:
    """Runs with their result count and best metrics; runs known only from files are appended."""
    best = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_results"), *[F.max(m).alias(f"max_{m}") for m in metrics]
    )
    stored = runs.join(best, "run_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    missing = extra_runs.join(runs, "run_id", "left_anti").join(best, "run_id", "left")
    return stored.withColumn("origin", F.lit("table")).unionByName(
        missing.withColumn("origin", F.lit("files")), allowMissingColumns=True
    )


def subtype_pairs(results: DataFrame, group: Sequence[str], subtypes: Sequence[str], metric: str) -> DataFrame:
    """Groups holding every required subtype, its metric spread into prefixed columns."""
    wide = results.groupBy(*group).pivot("subtype", list(subtypes)).agg(
        F.max(metric).alias(metric), F.count(F.lit(1)).alias("n")
    )
    complete = all_true([F.coalesce(F.col(f"{s}_n"), F.lit(0)) > 0 for s in subtypes])
    return wide.where(complete)


def coverage(tiles: DataFrame) -> DataFrame:
    """Terminal flag and role of every registered tile."""
    terminal = F.col("status").isin("completed", "skipped")
    role = (
        F.when(F.col("status") == "completed", "effective")
        .when(F.col("status") == "skipped", "parent")
        .otherwise("outstanding")
    )
    return tiles.withColumns({"coverage_terminal": terminal, "coverage_role": role})


def evidence_rows(ranks: DataFrame, models: DataFrame, *, rrf_k: Column) -> DataFrame:
    """Per-source model evidence with its fusion contribution."""
    return ranks.join(models, "result_id").withColumn(
        "rrf_contribution", F.lit(1.0) / (rrf_k + F.col("model_rank"))
    )
