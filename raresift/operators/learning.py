"""Training with Spark ML: pipelines, out-of-fold scores, thresholds and isolation trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def build_pipeline(kind: str, features: Sequence[str], *, weighted: bool = True, **options) -> Pipeline:
    """Median imputation, scaling for the linear model, and the estimator.

    Class weights are used only when no sampler has balanced the classes.
    """
    filled = [f"{f}__filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
    ]
    column = "raw_features"
    if kind == "logistic_regression":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
        column = "features"
    shared = {"featuresCol": column, "labelCol": "target"}
    if weighted:
        shared["weightCol"] = "weight"
    makers = {
        "logistic_regression": lambda: LogisticRegression(maxIter=options.get("maxIter", 50), **shared),
        "random_forest": lambda: RandomForestClassifier(
            numTrees=options.get("numTrees", 20), maxDepth=options.get("maxDepth", 5), seed=42, **shared
        ),
        "boosted_trees": lambda: GBTClassifier(maxIter=options.get("maxIter", 10), maxDepth=options.get("maxDepth", 3), seed=42, **shared),
    }
    return Pipeline(stages=[*stages, makers[kind]()])


def with_weights(df: DataFrame) -> DataFrame:
    """Positives weigh negatives/positives, negatives weigh 1."""
    row = df.agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("n")).first()
    return df.withColumn("weight", F.when(F.col("target") == 1, F.lit(row["n"] / max(row["p"], 1))).otherwise(1.0))


def predict(model, df: DataFrame) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def out_of_fold(df: DataFrame, kind: str, features: Sequence[str], *, folds: int, **options) -> DataFrame:
    """Average held-out score per row; ``df`` carries (repeat, fold) per row, fitted fold by fold."""
    rows = with_weights(df)
    repeats = [r["repeat"] for r in df.select("repeat").distinct().collect()]
    scored = None
    for repeat in repeats:
        for fold in range(folds):
            part = rows.where(F.col("repeat") == repeat)
            model = build_pipeline(kind, features, **options).fit(part.where(F.col("fold") != fold))
            out = predict(model, part.where(F.col("fold") == fold)).select("source_id", "target", "score")
            scored = out if scored is None else scored.unionByName(out)
    return scored.groupBy("source_id", "target").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_scores"))


def threshold_scores(oof: DataFrame, calibration: DataFrame) -> DataFrame:
    """Scores used to choose a threshold: positives out of fold plus unseen negatives, or all out-of-fold rows."""
    if calibration.isEmpty():
        return oof
    if not calibration.where("target = 1").isEmpty():
        raise ValueError("calibration rows must be negatives")
    return oof.where("target = 1").unionByName(calibration)


# ---- isolation trees ----------------------------------------------------------------------


def grow_tree(points: np.ndarray, rng: np.random.Generator, sample: int) -> list[tuple[int, int, float, float]]:
    """(node, feature, split, path) of one random split tree; leaves have feature -1 and the path length to them."""
    nodes, limit = [], int(np.ceil(np.log2(sample)))

    def split(points, depth, node):
        spans = points.max(axis=0) - points.min(axis=0)
        if depth >= limit or len(points) <= 1 or not (spans > 0).any():
            nodes.append((node, -1, 0.0, depth + path_length(len(points))))
            return
        f = int(rng.choice(np.flatnonzero(spans > 0)))
        at = float(rng.uniform(points[:, f].min(), points[:, f].max()))
        nodes.append((node, f, at, 0.0))
        split(points[points[:, f] < at], depth + 1, 2 * node + 1)
        split(points[points[:, f] >= at], depth + 1, 2 * node + 2)

    split(points, 0, 0)
    return nodes


def flat_trees(trees: Sequence[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, split and path of the nodes of all trees (node -> feature, split, path), a row a tree and a column a heap place.

    What lies below a leaf repeats its path, so all trees have one depth and rows walk down side by side.
    """
    depth = max(int(np.log2(node + 1)) for tree in trees for node in tree)
    shape = len(trees), 2 ** (depth + 1) - 1
    feature, at, path = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape)
    for k, tree in enumerate(trees):
        for node in range(shape[1]):
            if node in tree and tree[node][0] >= 0:
                feature[k, node], at[k, node] = tree[node][:2]
            else:
                path[k, node] = tree[node][2] if node in tree else path[k, (node - 1) // 2]
    return feature, at, path


def forest_scores(x: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray], sample: int) -> np.ndarray:
    """Anomaly scores of rows under ``flat_trees``, turned so that larger means more typical."""
    total, values, first = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for feature, at, path in zip(*trees, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(path) + 1)) - 1):
            right = ~(values.take(first + feature.take(node)) < at.take(node))
            node += node + 1
            node += right
        total += path.take(node)
    return -(2.0 ** (-total / len(trees[0]) / path_length(sample)))


def path_length(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n if n > 2 else 1.0
