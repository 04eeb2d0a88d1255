"""Splits, stratified reduction, resampling and robust refits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from raresift.functions.hashing import blake_bucket, md5_bucket, md5_number
from raresift.operators.neighbours import with_nearest
from raresift.operators.ordered import global_rank
from raresift.operators.quantiles import exact_quantiles, mad_sigma
from raresift.session import cut_lineage


def holdout_flag(fraction: float, seed: int, *, key: str = "source_id", target: str | None = None,
                 exact_digest: bool = False) -> Column:
    """Stable hash split; rows without a class stay in training."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    bucket = (blake_bucket if exact_digest else md5_bucket)(F.col(key), seed)
    inside = bucket < int(fraction * 10_000)
    return inside if target is None else inside & F.col(target).isNotNull()


def stratified_folds(df: DataFrame, *, splits: int, repeats: int, seed: int, target: str = "target") -> DataFrame:
    """Fold of every (row, repeat), balanced within each class.

    The number of folds shrinks to the smallest class, and two rows per class
    are the least that can be folded. Position in the class comes from a
    distributed rank, so a class of any size is dealt out evenly.
    """
    smallest = df.groupBy(target).count().agg(F.min("count")).first()[0]
    if smallest is None or smallest < 2:
        raise ValueError("at least two rows per class are needed")
    k = min(int(splits), int(smallest))
    repeated = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = md5_number(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("source_id").cast("string")))
    ranked = global_rank(
        repeated.withColumn("__h", order), by=["repeat", target], order=[F.asc("__h"), F.asc("source_id")], name="__place"
    )
    return ranked.withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__h", "__place")


def stratum_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantile edges of each column (a few numbers per column reach the driver)."""
    probs = [i / bins for i in range(bins + 1)]
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    rows = exact_quantiles(df.select(pairs), "value", probs, by=["column"], names=[f"e{i}" for i in range(bins + 1)])
    edges = {c: [] for c in columns}
    for row in rows.collect():
        edges[row["column"]] = sorted({row[f"e{i}"] for i in range(bins + 1)})
    return edges


def colour_stratum(edges: Mapping[str, Sequence[float]]) -> Column:
    """Bin labels joined by ``|``; NULL is 'missing', a constant column is 'all'.

    The published rule tests the wrong quantity, so columns without NULLs all
    collapse to 'all'; this is the intended rule.
    """
    labels = []
    for column, cuts in edges.items():
        if len(cuts) < 2:
            labels.append(F.lit("all"))
            continue
        below = sum((F.when(F.col(column) > F.lit(float(e)), 1).otherwise(0) for e in cuts), F.lit(0))
        place = F.greatest(below - 1, F.lit(0)).cast("string")
        labels.append(F.when(F.col(column).isNull() | F.isnan(F.col(column)), "missing").otherwise(place))
    return F.concat_ws("|", *labels)


def largest_remainder(counts: DataFrame, target_n: int) -> DataFrame:
    """Quota of each stratum: floors first, then one more by falling fraction.

    Strata are at most bins**columns, so windows over their counts are small.
    """
    everything = W.partitionBy(F.lit(1))
    raw = F.col("count") * F.lit(float(target_n)) / F.sum("count").over(everything)
    base = counts.withColumn("raw", F.round(raw, 9)).withColumn("floor", F.floor("raw")).withColumn(
        "fraction", F.round(F.col("raw") - F.col("floor"), 9)
    )
    left = F.lit(int(target_n)) - F.sum("floor").over(everything)
    place = F.row_number().over(
        W.orderBy(F.desc(F.col("floor") < F.col("count")), F.desc("fraction"), F.asc("stratum"))
    )
    more = (place <= left) & (F.col("floor") < F.col("count"))
    return base.select("stratum", "count", (F.col("floor") + more.cast("long")).alias("quota"))


def sample_by_strata(df: DataFrame, *, target_n: int, columns: Sequence[str], bins: int = 4, seed: int = 42) -> DataFrame:
    """Exactly ``target_n`` rows with the strata kept in proportion, chosen by a stable hash.

    Edges, quotas and ranks each read the rows, which are therefore written once.
    The hash is uniform, so only rows below a stratum's share, with a margin, are
    ranked. Should some stratum then hold fewer than its quota, the margin grows;
    at a share of one all rows are in.
    """
    df = cut_lineage(df)
    tagged = df.withColumn("stratum", colour_stratum(stratum_edges(df, columns, bins)))
    quotas = cut_lineage(largest_remainder(tagged.groupBy("stratum").count(), target_n).select("stratum", "quota", "count"))
    hashed = tagged.withColumn("__h", md5_number(F.concat(F.lit(f"{seed}:"), F.col("source_id").cast("string"))))
    margin = 1.0
    while True:
        share = (F.col("quota") + margin * (6 * F.sqrt("quota") + 20)) / F.col("count")
        below = (share >= 1) | (F.col("__h") < share * float(1 << 60))
        near = cut_lineage(hashed.join(quotas, "stratum").where(below).select(*df.columns, "stratum", "quota", "__h"))
        held = near.groupBy("stratum").agg(F.count(F.lit(1)).alias("held"))
        if quotas.join(held, "stratum", "left").where(F.coalesce("held", F.lit(0)) < F.col("quota")).isEmpty():
            break
        margin *= 8
    ranked = global_rank(near, by=["stratum"], order=[F.asc("__h"), F.asc("source_id")], name="__place")
    return ranked.where(F.col("__place") <= F.col("quota")).select(*df.columns, "stratum")


def reduce_negatives(
    df: DataFrame, *, ratio: int | None, columns: Sequence[str], fraction: float = 0.2, bins: int = 4, seed: int = 42
) -> DataFrame:
    """Holdout, all positives, sampled negatives and the rest as calibration; ``ratio=None`` keeps all.

    The rows are read several times and therefore written once; hand over the columns that are needed.
    """
    split = cut_lineage(df.withColumn("__hold", holdout_flag(fraction, seed, target="target")))
    train = split.where("not __hold")
    counts = train.groupBy("target").count().collect()  # one row per class
    size = {row["target"]: row["count"] for row in counts}
    positives, negatives = size.get(1, 0), size.get(0, 0)
    wanted = negatives if ratio is None else min(negatives, ratio * positives)
    negative_rows = train.where("target = 0").select("source_id", *columns)
    if wanted < negatives:
        kept = sample_by_strata(negative_rows, target_n=wanted, columns=columns, bins=bins, seed=seed).select("source_id")
        mark = kept.withColumn("__kept", F.lit(True))
        tagged = split.join(mark, "source_id", "left")
    else:
        tagged = split.withColumn("__kept", F.lit(True))
    name = (
        F.when(F.col("__hold"), "holdout")
        .when((F.col("target") == 1) | F.col("__kept"), "train")
        .otherwise("threshold_calibration")
    )
    labelled = tagged.withColumn("modeling_split", name)
    return labelled.withColumn("reduction_keep", F.col("modeling_split") != "threshold_calibration").drop("__hold", "__kept")


def stable_sample(df: DataFrame, n: int, *, seed: int = 42, key: str = "source_id") -> DataFrame:
    """``n`` rows, the same on every run and any partitioning."""
    order = md5_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("__h", order).orderBy("__h", key).limit(n).drop("__h")


# ---- robust refits ------------------------------------------------------------------

_DRAWS = 1 << 30  # resolution of the uniform hash


def _poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities, down to a tail that no drawn number can reach."""
    steps, term, total, k = [], math.exp(-1.0), 0.0, 0
    while 1.0 - total > 0.5 / _DRAWS:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return steps


def bootstrap_weights(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, w) copies of each row with Poisson(1) weights from a hash; zero weights vanish."""
    u = F.pmod(F.xxhash64("source_id", "rep", F.lit(seed)), F.lit(_DRAWS)) / F.lit(float(_DRAWS))
    weight = sum((F.when(u > p, 1).otherwise(0) for p in _poisson_steps()), F.lit(0))
    spread = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return spread.withColumn("w", weight).where("w > 0")


def fold_weights(df: DataFrame, folds: int, seed: int) -> DataFrame:
    """(rep, w) copies where replicate ``i`` leaves fold ``i`` out (w = 0 marks validation rows)."""
    fold = F.pmod(F.xxhash64("source_id", F.lit(seed)), F.lit(folds))
    spread = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return spread.withColumn("w", F.when(fold == F.col("rep"), 0).otherwise(1))


def huber_by_replicate(rows: DataFrame, x: str, y: str, *, epsilon: float = 1.35, iterations: int = 25) -> dict[int, tuple]:
    """Huber line of every replicate at once, by reweighted least squares.

    Each step is one combining aggregate over all rows; only (slope, intercept,
    scale) per replicate travel to the driver and back as literals. The scale
    solves its own stationarity condition, so slope, intercept and scale reach
    the joint optimum of the concomitant-scale loss.
    """
    base = rows.where("w > 0").select("rep", F.col(x).alias("x"), F.col(y).alias("y"), F.col("w").cast("double").alias("w"))
    start = base.groupBy("rep").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy"),
    )
    fits: dict[int, tuple] = {}
    for r in start.collect():  # one row per replicate
        d = r["n"] * r["sxx"] - r["sx"] ** 2
        slope = (r["n"] * r["sxy"] - r["sx"] * r["sy"]) / d if d else 0.0
        intercept = (r["sy"] - slope * r["sx"]) / r["n"]
        rss = r["syy"] - intercept * r["sy"] - slope * r["sxy"]
        fits[r["rep"]] = (slope, intercept, math.sqrt(max(rss / r["n"], 1e-12)))
    e = float(epsilon)
    for _ in range(iterations):
        table = F.create_map(*[
            item for rep, (m, b, s) in fits.items()
            for item in (F.lit(rep), F.struct(F.lit(m).alias("m"), F.lit(b).alias("b"), F.lit(s).alias("s")))
        ])
        at = base.withColumn("f", table[F.col("rep")])
        r = F.col("y") - (F.col("f.b") + F.col("f.m") * F.col("x"))
        inside = F.abs(r) <= e * F.col("f.s")
        q = F.col("w") * F.when(inside, 1.0 / F.col("f.s")).otherwise(F.lit(e) / F.abs(r))
        sums = at.groupBy("rep").agg(
            F.sum("w").alias("n"),
            F.sum(F.when(~inside, F.col("w")).otherwise(0.0)).alias("out"),
            F.sum(F.when(inside, F.col("w") * r * r).otherwise(0.0)).alias("rss"),
            F.sum(q).alias("q"), F.sum(q * F.col("x")).alias("qx"), F.sum(q * F.col("y")).alias("qy"),
            F.sum(q * F.col("x") * F.col("x")).alias("qxx"), F.sum(q * F.col("x") * F.col("y")).alias("qxy"),
        ).collect()
        moved = 0.0
        for row in sums:
            d = row["q"] * row["qxx"] - row["qx"] ** 2
            m = (row["q"] * row["qxy"] - row["qx"] * row["qy"]) / d if d else 0.0
            b = (row["qy"] - m * row["qx"]) / row["q"]
            free = row["n"] - row["out"] * e * e
            old = fits[row["rep"]]
            s = math.sqrt(max(row["rss"] / free, 1e-12)) if free > 0 else old[2]
            moved = max(moved, abs(m - old[0]), abs(b - old[1]), abs(s - old[2]))
            fits[row["rep"]] = (m, b, s)
        if moved < 1e-9:
            break
    return fits


def fold_stability(rows: DataFrame, x: str, y: str, fits: Mapping[int, tuple]) -> DataFrame:
    """Train and validation R² and MAD sigma of each fold's fit."""
    table = F.create_map(*[
        item for rep, (m, b, _) in fits.items() for item in (F.lit(rep), F.struct(F.lit(m).alias("m"), F.lit(b).alias("b")))
    ])
    judged = rows.withColumn("f", table[F.col("rep")]).select(
        "rep", F.when(F.col("w") > 0, "train").otherwise("validation").alias("part"), F.col(y).alias("y"),
        (F.col(y) - (F.col("f.b") + F.col("f.m") * F.col(x))).alias("residual"),
    )
    keys = ["rep", "part"]
    r2 = judged.groupBy(*keys).agg(
        (1 - F.sum(F.col("residual") * F.col("residual")) / (F.var_pop("y") * F.count("y"))).alias("r2")
    )
    return r2.join(mad_sigma(judged, "residual", by=keys), keys)


# ---- nearest neighbours and oversampling ------------------------------------------------


def nearest_neighbours(query: DataFrame, base: DataFrame, features: Sequence[str], k: int, *, block_rows: int = 8192) -> DataFrame:
    """Exact k nearest other rows: (source_id, neighbour_id, neighbour_target, distance, place); see ``with_nearest``."""
    found = with_nearest(query.select("source_id", *features), base, features, k, block_rows=block_rows)
    return found.select("source_id", F.posexplode("near").alias("place", "n")).select(
        "source_id", "n.*", (F.col("place") + 1).alias("place")
    )


def random_oversample(df: DataFrame, *, seed: int = 42) -> DataFrame:
    """Repeat minority rows until the classes are equal; the extra copies go to the first rows by hash."""
    size = {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}
    minority = min(size, key=size.get)
    times, rest = divmod(max(size.values()), size[minority])
    hashed = df.where(F.col("target") == minority).withColumn("__h", F.xxhash64("source_id", F.lit(seed)))
    ranked = global_rank(hashed, order=[F.asc("__h"), F.asc("source_id")], name="__p")
    copies = F.lit(times) + F.when(F.col("__p") <= rest, 1).otherwise(0)
    grown = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return df.where(F.col("target") != minority).withColumn("copy", F.lit(1)).unionByName(grown.drop("__h", "__p"))


def smote(df: DataFrame, features: Sequence[str], *, k: int = 3, seed: int = 42, named: bool = False) -> DataFrame:
    """Synthetic minority rows on segments to one of the k nearest minority rows.

    Returns the originals plus synthetic rows (NULL ``source_id``, or with ``named`` a negative one of their own), classes equal.
    """
    size = {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}
    minority = min(size, key=size.get)
    need, have = max(size.values()) - size[minority], size[minority]
    low = df.where(F.col("target") == minority)
    vectors = low.select(F.col("source_id").alias("neighbour_id"), F.array(*features).alias("other"))
    near = nearest_neighbours(low, low, features, k)
    around = near.join(vectors, "neighbour_id").groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "other"))).alias("near")  # k entries
    )
    times, rest = divmod(need, have)
    ranked = global_rank(
        low.withColumn("__h", F.xxhash64("source_id", F.lit(seed))), order=[F.asc("__h"), F.asc("source_id")], name="__p"
    )
    count = F.lit(times) + F.when(F.col("__p") <= rest, 1).otherwise(0)
    # An empty sequence explodes to no row.
    grown = ranked.join(around, "source_id").withColumn(
        "copy", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")))
    )
    pick = F.pmod(F.xxhash64("source_id", "copy", F.lit(seed)), F.size("near")).cast("int")
    u = F.pmod(F.xxhash64("copy", "source_id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    moved = grown.withColumn("__o", F.get(F.col("near"), pick)["other"]).withColumn("__u", u)
    own = -F.abs(F.xxhash64("source_id", "copy", F.lit(minority))) - 1 if named else F.lit(None)
    synthetic = moved.select(
        own.cast("long").alias("source_id"),
        F.lit(minority).alias("target"),
        *[(F.col(f) + F.col("__u") * (F.get(F.col("__o"), i) - F.col(f))).alias(f) for i, f in enumerate(features)],
    )
    return df.select("source_id", "target", *features).unionByName(synthetic)


def drop_edited(df: DataFrame, features: Sequence[str], *, k: int = 3) -> DataFrame:
    """Edited nearest neighbours: a row stays only if all of its k nearest rows are of its class.

    A row without neighbours, such as one that lacks a feature, stays.
    """
    judged = with_nearest(df, df, features, k)
    against = F.exists("near", lambda n: n["neighbour_target"] != F.col("target"))
    return judged.where(~F.coalesce(against, F.lit(False))).select(*df.columns)


def drop_tomek_links(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Remove both ends of every pair of mutual nearest neighbours of different class."""
    nearest = nearest_neighbours(df, df, features, 1).join(df.select("source_id", "target"), "source_id").select(
        "source_id", "neighbour_id", (F.col("target") != F.col("neighbour_target")).alias("mixed")
    )
    back = nearest.select(F.col("source_id").alias("neighbour_id"), F.col("neighbour_id").alias("source_id"))
    links = nearest.where("mixed").join(back, ["source_id", "neighbour_id"], "left_semi").select("source_id")
    return df.join(links, "source_id", "left_anti")


def resample(df: DataFrame, name: str | None, features: Sequence[str], *, k: int = 3, seed: int = 42) -> DataFrame:
    """Named samplers of the training step."""
    if name in (None, "", "none", "null"):
        return df
    if name == "random_over_sampler":
        return random_oversample(df, seed=seed).drop("copy")
    if name in ("smote", "smote_enn", "smote_tomek"):
        # Several passes follow, so the input is written once instead of recomputed.
        df = cut_lineage(df)
        if name == "smote":
            return smote(df, features, k=k, seed=seed)
        # The clean-up step tells rows apart by id, also synthetic ones at the same position.
        named = cut_lineage(smote(df, features, k=k, seed=seed, named=True))
        return drop_edited(named, features, k=k) if name == "smote_enn" else drop_tomek_links(named, features)
    raise ValueError(f"unknown sampler: {name}")


# ---- quasi-random witnesses ------------------------------------------------------------


def low_discrepancy(spark, power: int, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """2**power points of an additive recurrence filling the box of ``bounds``."""
    d = len(bounds)
    g = 2.0
    for _ in range(60):  # positive root of g**(d+1) = g + 1
        g = (1.0 + g) ** (1.0 / (d + 1))
    n = F.col("id").cast("double")
    return spark.range(1 << power).select(
        "id",
        *[
            (F.lit(lo) + F.pmod(F.lit(0.5) + n * F.lit((1.0 / g) ** (i + 1)), F.lit(1.0)) * F.lit(hi - lo)).alias(c)
            for i, (c, (lo, hi)) in enumerate(bounds.items())
        ],
    )
