"""Row selections over whole frames: exclusions, cohorts, facets, review presets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions.photometry import all_true
from raresift.functions.text import exclusion_pattern


def exclude_types(df: DataFrame, *, known_ids: DataFrame, columns: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """Drop rows whose joined type text matches, or whose id is known."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.where(~joined.rlike(exclusion_pattern(tokens))).join(known_ids, "source_id", "left_anti")


def keep_counts(df: DataFrame, flag: str = "color_locus_keep") -> DataFrame:
    """How many rows the locus keeps and drops; an absent flag is an error."""
    if flag not in df.columns:
        raise KeyError(f"column missing: {flag}")
    return df.groupBy(F.col(flag).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def by_facets(df: DataFrame, facets: Mapping[str, Sequence[str]], *, accepted_only: bool = False) -> DataFrame:
    """AND of IN-lists; NULL reads as 'missing' and an empty list does not filter."""
    rules = [
        F.coalesce(F.col(c), F.lit("missing")).isin(list(values))
        for c, values in facets.items()
        if values and c in df.columns
    ]
    if accepted_only and "selection_status" in df.columns:
        rules.append(F.col("selection_status") == "accepted")
    return df.where(all_true(rules))


# Columns that identify or label a row and may not be features.
FORBIDDEN = ("source_id", "target", "label", "dataset_variant", "modeling_split")


def model_matrix(df: DataFrame, features: Sequence[str], *, target: str | None = None) -> DataFrame:
    """Complete cases over features and target; identity and locus columns are refused as features."""
    bad = [c for c in features if c in FORBIDDEN or c.startswith("color_locus_")]
    if bad:
        raise ValueError(f"not usable as features: {bad}")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise KeyError(f"features missing: {missing}")
    columns = [*features, *([target] if target else [])]
    return df.select("source_id", *columns).dropna(how="any", subset=columns)


def tag_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Flag ``kept``: every negative, and the positives listed in ``cohort``."""
    listed = cohort.select("source_id").distinct().withColumn("__in", F.lit(True))
    return df.join(listed, "source_id", "left").select(
        *df.columns, ((F.col("target") == 0) | F.col("__in").isNotNull()).alias("kept")
    )


def cohort_counts(tagged: DataFrame) -> DataFrame:
    """Before/after counts by class; the two negative counts must agree."""
    return tagged.agg(
        *[
            F.count_if((F.col("target") == cls) & (F.col("kept") | F.lit(when == "before"))).alias(f"{name}_{when}")
            for cls, name in ((1, "positives"), (0, "negatives"))
            for when in ("before", "after")
        ]
    )


def review_subsets(top_k: int) -> dict[str, Column]:
    """Named presets over (rank, target, predicted); a NULL rank lies behind the budget."""
    positive, inside = F.col("target") == 1, F.coalesce(F.col("rank") <= top_k, F.lit(False))
    hit = F.col("predicted") == 1
    return {
        "top_k": inside,
        "contaminants": ~positive & inside,
        "outside": positive & ~inside,
        "false_positives": ~positive & hit,
        "false_negatives": positive & ~hit,
        "positives": positive,
    }


def lineage_compatible(
    parent: DataFrame, layers: DataFrame, *, keys: Sequence[str], tolerant: Sequence[str]
) -> DataFrame:
    """Accepted layer rows agreeing with the parent wherever the parent states a value.

    ``parent`` must be one row (the chosen first-stage result), which is checked before it is broadcast.
    """
    if len(parent.limit(2).collect()) != 1:
        raise ValueError("exactly one parent result is needed")
    p, l = F.broadcast(parent).alias("p"), layers.where("selection_status = 'accepted'").alias("l")
    rule = all_true(
        [F.col(f"p.{c}") == F.col(f"l.{c}") for c in keys]
        + [F.col(f"p.{c}").isNull() | (F.col(f"p.{c}") == F.col(f"l.{c}")) for c in tolerant]
    )
    return l.join(p, rule).select(
        F.col("p.result_id").alias("parent_id"), F.col("l.result_id").alias("layer_id"), "l.*"
    )


def ranking_view(
    df: DataFrame,
    *,
    support: str,
    min_support: int,
    category: str,
    categories: Sequence[str],
    closed: Mapping[str, Sequence[str]],
    evidence: str | None,
    order: Sequence[Column],
    limit: int,
) -> DataFrame:
    """Review list with a support floor, categories, closed dispositions and a length of 1 to 10,000 rows."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must lie between 1 and 10,000")
    rules = [F.col(support) >= min_support]
    if categories:
        rules.append(F.col(category).isin(list(categories)))
    rules += [~F.col(c).isin(list(values)) for c, values in closed.items()]
    if evidence:
        rules.append(F.col(evidence).isNotNull())
    return df.where(all_true(rules)).orderBy(*order).limit(limit)


def annotate_acquisition(df: DataFrame, known: DataFrame, *, required: Sequence[str]) -> DataFrame:
    """Add the exclusion label without removing any row; refuse missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"acquisition columns missing: {missing}")
    return df.join(known, "source_id", "left")
