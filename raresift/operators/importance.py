"""What a fitted model leans on, and how its quality moves with its size."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.functions.hashing import md5_number
from raresift.operators import curves, training
from raresift.operators.ordered import global_rank
from raresift.session import cut_lineage, shared_dir


def model_importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """feature, kind, importance as the fitted estimator holds it: the gain shares of trees, or absolute coefficients."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        kind, values = "model", last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        kind, values = "coefficient", abs(last.coefficients.toArray())
    else:
        raise ValueError("the model has neither importances nor coefficients")
    rows = [(f, kind, float(v)) for f, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, kind string, importance double")


def f_beta(beta: float = 2.0) -> F.Column:
    """F-beta of the counts tp, fp, fn; 0 without a hit."""
    b2 = float(beta) ** 2
    return F.coalesce(F.try_divide((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")), F.lit(0.0))


def permutation_importance(
    score: Callable[[DataFrame], DataFrame], rows: DataFrame, features: Sequence[str], *, threshold: float = 0.5, repeats: int = 5,
    seed: int = 42, beta: float = 2.0,
) -> DataFrame:
    """feature, kind, importance, importance_std: mean and deviation, over ``repeats``, of the F-beta lost when a feature is taken from
    another row.

    ``rows`` (source_id, target, features) are held-out rows; ``score`` adds a column ``score``. Rows are put in one random order;
    a repeat moves all donors on by its own step, so every feature of a repeat has the same donors, and one join serves them all.
    All scores are counted in one grouped pass.
    """
    order = md5_number(F.concat(F.lit(f"{seed}:"), F.col("source_id").cast("string")))
    ranked = cut_lineage(global_rank(
        rows.select("source_id", "target", *features).withColumn("__h", order), order=[F.asc("__h"), F.asc("source_id")], name="__p"
    ).drop("__h"))
    n = ranked.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    steps = F.array(*[F.lit(1 + (31 * seed + 7919 * r) % (n - 1)) for r in range(repeats)])
    moved = ranked.select("*", F.posexplode(steps).alias("repeat", "__step")).withColumn("__at", (F.col("__p") - 1 + F.col("__step")) % n + 1)
    donors = ranked.select(F.col("__p").alias("__at"), *[F.col(f).alias(f"__d_{f}") for f in features])
    swapped = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"__d_{g}" if g == f else g).alias(g) for g in features]) for f in features
    ])
    frames = moved.join(donors, "__at").select("target", "repeat", F.inline(swapped))
    base = ranked.select("target", F.lit(-1).alias("repeat"), F.lit("").alias("feature"), *features)
    judged = score(frames.unionByName(base)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    values = cut_lineage(curves.confusion(judged, ["feature", "repeat"]).select("feature", "repeat", f_beta(beta).alias("value")))
    whole = values.where("repeat = -1").first()["value"]
    lost = F.lit(whole) - F.col("value")
    return values.where("repeat >= 0").groupBy("feature").agg(
        F.lit("permutation").alias("kind"), F.avg(lost).alias("importance"), F.stddev_pop(lost).alias("importance_std")
    )


def _quality(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each ``by``: F2 at one half and average precision of the parts cv and train, and the rows they hold. A row of
    ``scored`` stands for ``n`` equal ones if it has that column."""
    keys, count = [*by, "part"], "n" if "n" in scored.columns else None
    rates = curves.confusion(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), keys, count=count).select(
        *keys, "f2", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows")
    )
    both = rates.join(curves.area_metrics(curves.score_steps(scored, keys, count=count), keys).select(*keys, F.col("average_precision").alias("ap")), keys, "left")
    return both.groupBy(*by).pivot("part", ["cv", "train"]).agg(F.first("f2").alias("f2"), F.first("ap").alias("ap"), F.first("rows").alias("rows"))


def complexity_grid(
    folded: DataFrame, kind: str, features: Sequence[str], axes: Mapping[str, Sequence], *, parallelism: int = 4, seed: int = 42
) -> DataFrame:
    """A row for each combination of ``axes`` (parameter names of the estimator): cross-validated against training F2 and average
    precision. ``folded`` holds source_id, target, fold and the features. Fits run side by side; metrics are one grouped job."""
    spark, folder = folded.sparkSession, f"{shared_dir(folded.sparkSession).rstrip('/')}/complexity-{uuid.uuid4().hex}"
    folds = folded.agg(F.max("fold")).first()[0] + 1
    cells = [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]

    # Imputation, scaling and the written rows depend on the fold alone; all cells share them.
    def prepared(fold: int | None) -> tuple[PipelineModel, DataFrame, dict]:
        train = folded if fold is None else folded.where(F.col("fold") != fold)
        *head, last = training.sampled_pipeline(kind, features, params=cells[0], seed=seed).getStages()
        head = Pipeline(stages=head).fit(train)
        return head, *last.rows_to_fit(head.transform(train))

    ways = [None, *range(folds)]
    made = dict(zip(ways, training._side_by_side(spark, [lambda k=k: prepared(k) for k in ways], parallelism), strict=True))

    def fit(number: int, fold: int | None) -> None:
        head, rows, counts = made[fold]
        judged = folded if fold is None else folded.where(F.col("fold") == fold)
        last = training.sampled_pipeline(kind, features, params=cells[number], seed=seed).getStages()[-1].fit_rows(rows, counts)
        # Trees give few distinct scores, so equal ones are counted before anything is written.
        out = training.scores_of(PipelineModel([*head.stages, last]), judged, "target").groupBy("target", "score").agg(F.count(F.lit(1)).alias("n"))
        out.select(F.lit(number).alias("cell"), F.lit("train" if fold is None else "cv").alias("part"), "target", "score", "n").write.parquet(
            f"{folder}/{number}-{fold}"
        )

    training._side_by_side(spark, [lambda n=n, k=k: fit(n, k) for n in range(len(cells)) for k in ways], parallelism)
    scored = spark.read.schema("cell int, part string, target int, score double, n long").parquet(f"{folder}/*")
    names = spark.createDataFrame(
        [(n, *[str(v) for v in c.values()]) for n, c in enumerate(cells)], "cell int, " + ", ".join(f"{a} string" for a in axes)
    )
    return names.join(_quality(scored, ["cell"]), "cell").drop("cell")


def boosting_rounds(folded: DataFrame, features: Sequence[str], rounds: Sequence[int], *, params: Mapping | None = None, parallelism: int = 4, seed: int = 42) -> DataFrame:
    """The same for boosted trees, by the number of rounds: one model a fold, and one for the training rows, is grown to the most
    rounds; the scores after fewer of them are the partial sums of its trees."""
    spark, folder = folded.sparkSession, f"{shared_dir(folded.sparkSession).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    folds = folded.agg(F.max("fold")).first()[0] + 1

    def fit(fold: int | None) -> None:
        train = folded if fold is None else folded.where(F.col("fold") != fold)
        judged = folded if fold is None else folded.where(F.col("fold") == fold)
        model = training.sampled_pipeline("boosted_trees", features, params={**(params or {}), "maxIter": max(rounds)}, seed=seed).fit(train)
        *prepare, booster = model.stages
        for stage in prepare:
            judged = stage.transform(judged)
        for number, tree in enumerate(booster.trees):
            judged = tree.copy().setPredictionCol(f"tree_{number}").setFeaturesCol(booster.getFeaturesCol()).transform(judged)
        after = [
            F.struct(F.lit(r).alias("rounds"), (1.0 / (1.0 + F.exp(-2.0 * sum(
                (F.col(f"tree_{n}") * float(w) for n, w in enumerate(booster.treeWeights[:r])), F.lit(0.0)
            )))).alias("score")) for r in sorted(rounds)
        ]
        part = F.lit("train" if fold is None else "cv").alias("part")
        judged.select(part, "source_id", "target", F.inline(F.array(*after))).write.parquet(f"{folder}/{fold}")

    training._side_by_side(spark, [lambda k=k: fit(k) for k in [None, *range(folds)]], parallelism)
    scored = spark.read.schema("part string, source_id long, target int, rounds int, score double").parquet(f"{folder}/*")
    return _quality(scored, ["rounds"])
