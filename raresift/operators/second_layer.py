"""Validators of the second stage: one-class models of each subtype's positives, fitted for all groups together.

A group is a feature set with a subtype. Its rows are never gathered: medians are exact grouped quantiles, and a pass over the rows
gives the weighted moments of every group and component at once, which is all that mixtures and trimmed covariances need.
Isolation trees grow from at most ``SAMPLE`` rows each. What the driver holds is a few numbers per group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from raresift.operators import curves, learning
from raresift.operators.quantiles import exact_quantiles
from raresift.operators.ranking import top_per_group
from raresift.session import cut_lineage

METHODS = ("gaussian_mixture", "robust_covariance", "isolation_forest")
SAMPLE = 256  # rows of a tree
_RIDGE = 1e-5
_SCORES = "feature_set string, subtype string, method string, source_id long, target int, row_subtype string, modeling_split string, score double"


@dataclass
class Group:
    """What is known of a feature set's subtype: how its rows are imputed and scaled, and its fitted models."""

    feature_set: str
    subtype: str
    features: list[str]
    rows: int
    median: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None  # of the mixture, with its means and inverse covariances and their log constants
    means: np.ndarray | None = None
    covariances: np.ndarray | None = None
    centre: np.ndarray | None = None
    scatter: np.ndarray | None = None
    trees: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def matrix(self, batch: pd.DataFrame) -> np.ndarray:
        raw = batch[self.features].to_numpy(float)
        filled = np.where(np.isnan(raw), self.median, raw)
        return filled if self.mean is None else (filled - self.mean) / self.scale

    def log_parts(self, z: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row under every component."""
        out = np.empty((len(z), len(self.weights)))
        for k, (weight, mean, cov) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            gap, (_, logdet) = z - mean, np.linalg.slogdet(cov)
            distance = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
            out[:, k] = np.log(max(weight, 1e-300)) - 0.5 * (distance + logdet + z.shape[1] * np.log(2 * np.pi))
        return out

    def distance(self, z: np.ndarray) -> np.ndarray:
        gap = z - self.centre
        return np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(self.scatter + _RIDGE * np.eye(z.shape[1])), gap)

    def score(self, method: str, z: np.ndarray) -> np.ndarray:
        """Larger is more typical."""
        if method == "gaussian_mixture":
            parts = self.log_parts(z)
            top = parts.max(axis=1)
            return top + np.log(np.exp(parts - top[:, None]).sum(axis=1))
        if method == "robust_covariance":
            return -self.distance(z)
        return learning.forest_scores(z, self.trees, min(SAMPLE, self.rows))


def _moments(rows: DataFrame, groups: Sequence[Group], weigh) -> dict[tuple[int, int], np.ndarray]:
    """(group, component) -> [sum w, sum w z, sum w z z'] over the group's rows; ``weigh(group, z)`` gives one weight column a component."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for number, group in enumerate(groups):
                mine = batch[batch["subtype"] == group.subtype]
                if len(mine):
                    z = group.matrix(mine)
                    for k, w in enumerate(weigh(group, z).T):
                        value = np.concatenate([[w.sum()], w @ z, ((z * w[:, None]).T @ z).ravel()])
                        totals[number, k] = totals.get((number, k), 0) + value
        out = [(n, k, i, float(v)) for (n, k), values in totals.items() for i, v in enumerate(values)]
        yield pd.DataFrame(out, columns=["number", "component", "place", "value"])

    found = rows.mapInPandas(run, "number int, component int, place int, value double").groupBy("number", "component", "place").agg(
        F.sum("value").alias("value")
    )
    sums: dict[tuple[int, int], dict[int, float]] = {}
    for r in found.collect():  # groups x components x (1 + d + d * d) numbers
        sums.setdefault((r["number"], r["component"]), {})[r["place"]] = r["value"]
    return {key: np.array([parts[i] for i in range(len(parts))]) for key, parts in sums.items()}


def _mean_and_cov(total: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    weight, mean = total[0], total[1:1 + d] / total[0]
    return weight, mean, total[1 + d:].reshape(d, d) / weight - np.outer(mean, mean)


def _prepare(train: DataFrame, groups: Sequence[Group]) -> None:
    """Medians over the group's rows, then mean and deviation of the filled values; a constant feature has scale 1."""
    features = sorted({f for g in groups for f in g.features})
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = train.select("subtype", pairs).where(F.col("value").isNotNull() & ~F.isnan("value"))
    medians = {(r["subtype"], r["feature"]): r["m"] for r in exact_quantiles(long, "value", [0.5], by=["subtype", "feature"], names=["m"]).collect()}
    for g in groups:
        g.median = np.array([medians.get((g.subtype, f), 0.0) for f in g.features])
    totals = _moments(train, groups, lambda group, z: np.ones((len(z), 1)))
    for number, g in enumerate(groups):
        _, mean, cov = _mean_and_cov(totals[number, 0], len(g.features))
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        g.mean, g.scale = mean, np.where(scale > 1e-12, scale, 1.0)


def _fit_mixtures(train: DataFrame, groups: Sequence[Group], *, components: int, rounds: int, tolerance: float = 1e-4) -> None:
    """Expectation maximisation of all groups in step. Components start on either side of the centre, along the longest axis."""
    start = _moments(train, groups, lambda group, z: np.ones((len(z), 1)))
    for number, g in enumerate(groups):
        d, k = len(g.features), min(components, max(1, g.rows))
        _, mean, cov = _mean_and_cov(start[number, 0], d)
        values, vectors = np.linalg.eigh(cov)
        steps = np.linspace(-1.0, 1.0, k) if k > 1 else np.zeros(1)
        g.means = mean + steps[:, None] * np.sqrt(max(values[-1], 0)) * vectors[:, -1]
        g.weights, g.covariances = np.full(k, 1.0 / k), np.repeat((cov + _RIDGE * np.eye(d))[None], k, axis=0)

    def shares(group: Group, z: np.ndarray) -> np.ndarray:
        parts = group.log_parts(z)
        parts = np.exp(parts - parts.max(axis=1, keepdims=True))
        return parts / parts.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        totals, moved = _moments(train, groups, shares), 0.0
        for number, g in enumerate(groups):
            d = len(g.features)
            fresh = [_mean_and_cov(totals[number, k], d) for k in range(len(g.weights))]
            means = np.array([m for _, m, _ in fresh])
            moved = max(moved, float(np.abs(means - g.means).max()))
            g.weights = np.array([w for w, *_ in fresh]) / sum(w for w, *_ in fresh)
            g.means, g.covariances = means, np.array([c + _RIDGE * np.eye(d) for *_, c in fresh])
        if moved < tolerance:
            return


def _fit_covariances(train: DataFrame, groups: Sequence[Group], *, support: float, passes: int) -> None:
    """Location and scatter of the ``support`` share of rows that lie nearest, trimmed again after each pass."""
    limits: dict[int, float] = {}
    numbers = {(g.feature_set, g.subtype): number for number, g in enumerate(groups)}

    def inside(group: Group, z: np.ndarray) -> np.ndarray:
        if group.centre is None:
            return np.ones((len(z), 1))
        return (group.distance(z) <= limits[numbers[group.feature_set, group.subtype]]).astype(float)[:, None]

    for step in range(passes + 1):
        totals = _moments(train, groups, inside)
        for number, g in enumerate(groups):
            _, g.centre, g.scatter = _mean_and_cov(totals[number, 0], len(g.features))
        if step < passes:
            cuts = exact_quantiles(cut_lineage(_distances(train, groups)), "far", [support], by=["number"], names=["cut"]).collect()
            limits.update({r["number"]: r["cut"] for r in cuts})


def _grow_forests(train: DataFrame, groups: Sequence[Group], *, trees: int, seed: int) -> None:
    """Trees of all groups, each from ``SAMPLE`` rows drawn by hash; a hash also thins the rows before they are copied per tree."""
    byg = F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(g.subtype).alias("of")) for n, g in enumerate(groups)]))
    share = F.element_at(F.array(*[F.lit(min(1.0, 4.0 * SAMPLE / max(g.rows, 1))) for g in groups]), F.col("number") + 1)
    spread = train.withColumn("__of", byg).where("__of.of = subtype").withColumn("number", F.col("__of.number")).drop("__of").withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    )
    u = F.pmod(F.xxhash64("source_id", "tree", "number", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = top_per_group(
        spread.withColumn("u", u).where(F.col("u") < share), by=["number", "tree"], order=[F.asc("u"), F.asc("source_id")], limit=SAMPLE, rank="__p"
    )

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        number, tree = int(part["number"].iloc[0]), int(part["tree"].iloc[0])
        nodes = learning.grow_tree(groups[number].matrix(part), np.random.default_rng(seed + 1000 * number + tree), SAMPLE)
        return pd.DataFrame([(number, tree, *node) for node in nodes], columns=["number", "tree", "node", "feature", "at", "path"])

    found = drawn.groupBy("number", "tree").applyInPandas(grow, "number int, tree int, node long, feature int, at double, path double").toPandas()
    for number, part in found.groupby("number"):
        groups[number].trees = learning.flat_trees([{int(r.node): (int(r.feature), r.at, r.path) for r in t.itertuples()} for _, t in part.groupby("tree")])


def _distances(train: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """number, far: the distance of every row from the centre of each group it belongs to."""
    shared = train.sparkSession.sparkContext.broadcast(list(groups))  # a few numbers a group

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, g in enumerate(shared.value):
                mine = batch[batch["subtype"] == g.subtype]
                if len(mine):
                    yield pd.DataFrame({"number": number, "far": g.distance(g.matrix(mine))})

    return train.mapInPandas(run, "number int, far double")


def _scores(rows: DataFrame, fitted: Sequence[tuple[Group, str]]) -> DataFrame:
    """A column ``s<n>`` for each (group, method): the scores of negatives and of the subtype's own rows, NULL for others.

    Rows stay as wide as they are; ``_unfolded`` makes a row a score of them, in Spark and only where it is asked for.
    """
    shared = rows.sparkSession.sparkContext.broadcast(list(fitted))  # a few numbers a group
    wanted = sorted({g.subtype for g, _ in fitted})
    features = sorted({f for g, _ in fitted for f in g.features})
    of = functools.reduce(lambda rest, k: F.when(F.col("subtype") == wanted[k], F.lit(k)).otherwise(rest), range(len(wanted)), F.lit(-1))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for target, number, *values in batches:
            batch = pd.DataFrame(dict(zip(features, values, strict=True)))
            out, matrices = {}, {}
            for n, (g, method) in enumerate(shared.value):
                mine = ((target == 0) | (number == wanted.index(g.subtype))).to_numpy()
                key = g.feature_set, g.subtype
                if key not in matrices:
                    matrices[key] = g.matrix(batch[mine])
                out[f"s{n}"] = np.full(len(batch), np.nan)
                if mine.any():
                    out[f"s{n}"][mine] = g.score(method, matrices[key])
            yield pd.DataFrame(out)

    # The call's type hints are the form of pandas functions that Spark reads.
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    judge = F.pandas_udf(run, ", ".join(f"s{n} double" for n in range(len(fitted))))
    scored = rows.withColumn("s", judge("target", of, *features)).select(
        "source_id", "target", F.col("subtype").alias("row_subtype"), "modeling_split", "s.*"
    )
    mine = [(F.col("target") == 0) | F.coalesce(F.col("row_subtype") == g.subtype, F.lit(False)) for g, _ in fitted]
    return scored.withColumns({f"s{n}": F.when(own, F.col(f"s{n}")) for n, own in enumerate(mine)})


def _unfolded(wide: DataFrame, fitted: int, *keep: str) -> DataFrame:
    """``keep``, number, score: a row a score that is not NULL."""
    held = F.array(*[F.struct(F.lit(n).alias("number"), F.col(f"s{n}").alias("score")) for n in range(fitted)])
    return wide.select(*keep, F.inline(held)).where("score IS NOT NULL")


def fit_validators(
    rows: DataFrame, feature_sets: Mapping[str, Sequence[str]], subtypes: Sequence[str], *, methods: Sequence[str] = METHODS,
    min_features: int = 4, min_train: int = 20, recall: float = 0.9, components: int = 2, rounds: int = 30, trees: int = 100,
    support: float = 0.9, passes: int = 3, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(results, scores): a result row for every (feature set, subtype, method), fitted or skipped with its reason, and the long
    scores of all rows that a fitted validator judges.

    ``rows`` holds source_id, target, subtype (NULL for negatives), modeling_split and features. Features without any value are
    dropped; a set left with fewer than ``min_features`` is one skipped row. The threshold keeps ``recall`` of the training scores.
    Metrics are over holdout rows that are of the subtype or negative, and over calibration negatives.
    """
    spark = rows.sparkSession
    every = sorted({f for features in feature_sets.values() for f in features if f in rows.columns})
    rows = cut_lineage(rows.select("source_id", F.col("target").cast("int").alias("target"), F.when(F.col("target") == 1, F.col("subtype")).alias("subtype"),
                                   "modeling_split", *[F.col(f).cast("double").alias(f) for f in every]))
    filled = rows.agg(*[F.count(F.when(~F.isnan(f), F.col(f))).alias(f) for f in every]).first().asDict() if every else {}
    # Some twenty passes read these rows and no others.
    train = cut_lineage(rows.where((F.col("modeling_split") == "train") & F.col("subtype").isin(list(subtypes))))
    sizes = {r["subtype"]: r["count"] for r in train.groupBy("subtype").count().collect()}
    facts, groups, fitted = [], [], {}
    for name, wanted in feature_sets.items():
        have = [f for f in wanted if filled.get(f)]
        text = ",".join(have), ",".join(f for f in wanted if f not in have)
        if len(have) < min_features:
            facts.append((name, "all", "all", "skipped", "insufficient_available_features", *text, len(have), None))
            continue
        for subtype in subtypes:
            n = sizes.get(subtype, 0)
            good = [m for m in methods if n >= min_train and (m != "robust_covariance" or n > len(have))]
            for method in methods:
                reason = None if method in good else "insufficient_train_positives" if n < min_train else "fewer_rows_than_features"
                facts.append((name, subtype, method, "skipped" if reason else "accepted", reason, *text, len(have), n))
            if good:
                groups.append(Group(name, subtype, have, n))
                fitted[name, subtype] = good
    columns = "feature_set string, subtype string, method string, status string, reason string, available_features string, " \
              "missing_features string, n_features long, train_positive_count long"
    table = spark.createDataFrame(facts, columns)
    if groups:
        _prepare(train, groups)
        using = lambda method: [g for g in groups if method in fitted[g.feature_set, g.subtype]]
        if "gaussian_mixture" in methods and using("gaussian_mixture"):
            _fit_mixtures(train, using("gaussian_mixture"), components=components, rounds=rounds)
        if "robust_covariance" in methods and using("robust_covariance"):
            _fit_covariances(train, using("robust_covariance"), support=support, passes=passes)
        if "isolation_forest" in methods and using("isolation_forest"):
            _grow_forests(train, using("isolation_forest"), trees=trees, seed=seed)
        pairs = [(g, method) for g in groups for method in fitted[g.feature_set, g.subtype]]
        judged = cut_lineage(_scores(rows.where("target = 0 OR subtype IS NOT NULL"), pairs))
        own = judged.where("modeling_split = 'train' AND target = 1")
        limits = {r["number"]: r["threshold"] for r in exact_quantiles(
            cut_lineage(_unfolded(own, len(pairs))), "score", [1.0 - recall], by=["number"], names=["threshold"]
        ).collect()}  # a row a validator
    keys = ["feature_set", "subtype", "method"]
    if not groups or not limits:
        none = spark.createDataFrame([], f"{_SCORES}, threshold double, passed boolean")
        empty = none.groupBy(*keys).agg(F.max("threshold").alias("threshold"))
        return table.join(empty, keys, "left").join(validator_metrics(none, keys), keys, "left"), none
    found = spark.createDataFrame(
        [(n, g.feature_set, g.subtype, method, limits[n]) for n, (g, method) in enumerate(pairs) if n in limits],
        "number int, feature_set string, subtype string, method string, threshold double",
    )
    passed = functools.reduce(lambda rest, n: F.when(F.col("number") == n, F.col("score") >= F.lit(limits[n])).otherwise(rest), limits, F.lit(None).cast("boolean"))
    scored = _unfolded(judged, len(pairs), "source_id", "target", "row_subtype", "modeling_split").withColumn("passed", passed).join(
        found, "number"
    ).select(*keys, "source_id", "target", "row_subtype", "modeling_split", "score", "threshold", "passed")
    metrics = found.join(_rates(judged, limits), "number").join(_areas(judged, len(pairs)), "number", "left").drop("number")
    return table.join(metrics, keys, "left"), scored


def _rates(judged: DataFrame, limits: Mapping[int, float]) -> DataFrame:
    """The counts and shares of ``validator_metrics`` for all columns ``s<n>`` at once: one row is aggregated, then unfolded."""
    hold, calibration, positive = F.col("modeling_split") == "holdout", F.col("modeling_split") == "threshold_calibration", F.col("target") == 1
    parts = {
        "holdout_positive_count": hold & positive, "holdout_negative_count": hold & ~positive, "calibration_negative_count": calibration & ~positive
    }
    shares = {
        "holdout_positive_retention": hold & positive, "holdout_negative_pass_rate": hold & ~positive,
        "calibration_negative_pass_rate": calibration & ~positive,
    }

    def facts(n: int) -> Column:
        score = F.col(f"s{n}")
        held, passed = score.isNotNull(), (score >= F.lit(limits[n])).cast("double")
        return F.struct(
            F.lit(n).alias("number"), *[F.count_if(rule & held).alias(c) for c, rule in parts.items()],
            *[F.avg(F.when(rule & held, passed)).alias(c) for c, rule in shares.items()],
        )

    return judged.agg(F.array(*[facts(n) for n in limits]).alias("facts")).select(F.inline("facts")).select(
        "number", "holdout_positive_count", "holdout_negative_count", "holdout_positive_retention", "holdout_negative_pass_rate",
        "calibration_negative_count", "calibration_negative_pass_rate",
    )


def _areas(judged: DataFrame, fitted: int) -> DataFrame:
    """number, average precision and ROC area over holdout rows."""
    steps = curves.score_steps(_unfolded(judged.where("modeling_split = 'holdout'"), fitted, "target"), ["number"])
    return curves.area_metrics(steps, ["number"]).select(
        "number", F.col("average_precision").alias("holdout_average_precision"), F.col("roc_auc").alias("holdout_roc_auc")
    )


def validator_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Retention, pass rates, average precision and ROC area of judged rows (target, modeling_split, score, passed)."""
    hold, calibration = F.col("modeling_split") == "holdout", F.col("modeling_split") == "threshold_calibration"
    positive, passed = F.col("target") == 1, F.col("passed").cast("double")
    counts = scored.groupBy(*by).agg(
        F.count_if(hold & positive).alias("holdout_positive_count"), F.count_if(hold & ~positive).alias("holdout_negative_count"),
        F.avg(F.when(hold & positive, passed)).alias("holdout_positive_retention"),
        F.avg(F.when(hold & ~positive, passed)).alias("holdout_negative_pass_rate"),
        F.count_if(calibration & ~positive).alias("calibration_negative_count"),
        F.avg(F.when(calibration & ~positive, passed)).alias("calibration_negative_pass_rate"),
    )
    areas = curves.area_metrics(curves.score_steps(scored.where(hold), by), by).select(
        *by, F.col("average_precision").alias("holdout_average_precision"), F.col("roc_auc").alias("holdout_roc_auc")
    )
    return counts.join(areas, list(by), "left")


def validator_pairs(cases: DataFrame, scores: DataFrame, *, names: Mapping[str, str], by: Sequence[str] = ("feature_set", "method")) -> DataFrame:
    """Cases judged by a pair of validators, for each (feature set, method) that has both: score and verdict of each, and their OR.

    ``names`` maps a subtype to its column prefix. A validator that judged a case twice, or not at all, is refused.
    """
    by = list(by)
    subtypes = list(names)
    wanted = scores.where(F.col("subtype").isin(subtypes))
    whole = wanted.groupBy(*by).agg(F.count_distinct("subtype").alias("n")).where(F.col("n") == len(subtypes)).select(*by)
    held = wanted.join(whole, by).join(cases.select("source_id").distinct(), "source_id", "left_semi")
    columns = [
        e for s, prefix in names.items() for e in (
            F.max(F.when(F.col("subtype") == s, F.col("score"))).alias(f"{prefix}_score"),
            F.max(F.when(F.col("subtype") == s, F.col("passed"))).alias(f"{prefix}_pass"),
            F.count_if(F.col("subtype") == s).alias(f"__n_{prefix}"),
        )
    ]
    wide = cut_lineage(held.groupBy(*by, "source_id").agg(*columns))
    pairs = [F.struct(*[F.lit(r[c]).alias(c) for c in by]) for r in whole.collect()]  # a row a feature set and method
    if not pairs:
        return wide.drop(*[f"__n_{p}" for p in names.values()]).withColumn("second_layer_pass", F.lit(None).cast("boolean"))
    asked = cases.select("source_id", F.inline(F.array(*pairs)))
    joined = cut_lineage(asked.join(wide, ["source_id", *by], "left"))
    once = functools.reduce(Column.__and__, [F.coalesce(F.col(f"__n_{p}"), F.lit(0)) == 1 for p in names.values()])
    if not joined.where(~once).isEmpty() or not joined.groupBy("source_id", *by).count().where("count > 1").isEmpty():
        raise ValueError("cases and scores do not match one to one")
    passed = functools.reduce(Column.__or__, [F.col(f"{p}_pass") for p in names.values()])
    return joined.withColumn("second_layer_pass", passed).drop(*[f"__n_{p}" for p in names.values()])
