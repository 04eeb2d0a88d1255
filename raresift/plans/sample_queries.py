"""Split, stratification, resampling and geometric-witness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.functions import photometry as ph
from raresift.operators import audits, containment, locus, sampling
from raresift.plans.filter_queries import COLOUR_SQL
from raresift.plans.locus_queries import LOCI, WIDE, count_sql, margin_sql
from raresift.plans.registry import query
from raresift.session import cut_lineage

_CLASS = """cls as (select l.source_id, case when l.quality = 0 and l.target = 0 then null else l.target end target from v_label l)"""


@query(
    "sm_01_holdout",
    f"""with {_CLASS} select source_id, target is not null and (BUCKET(concat('42:', cast(source_id as string))) % 10000) < 2000
      holdout from cls""",
)
def sm_01(t):
    cls = t.label.withColumn("target", F.when(~((F.col("quality") == 0) & (F.col("target") == 0)), F.col("target")))
    return cls.select("source_id", sampling.holdout_flag(0.2, 42, target="target").alias("holdout"))


@query(
    "sm_02_folds",
    """with r as (select source_id, target, rep, BUCKET(concat('7:', cast(rep as string), ':', cast(source_id as string))) h
        from v_label, range(3) x(rep)),
    k as (select least(5, (select min(n) from (select count(*) n from v_label group by target))) k)
    select source_id, cast(rep as int) repeat, cast((row_number() over (partition by rep, target order by h, source_id) - 1) % k as int) fold
    from r, k""",
)
def sm_02(t):
    folds = sampling.stratified_folds(t.label, splits=5, repeats=3, seed=7)
    return folds.select("source_id", "repeat", "fold")


_STRATA = ["G", "BP", "RP"]


def _stratum_sql(source):
    heads = ", ".join(
        f"e{i} as (select list_sort(list_distinct([quantile_cont({c}, 0.0), quantile_cont({c}, 0.25), quantile_cont({c}, 0.5),"
        f" quantile_cont({c}, 0.75), quantile_cont({c}, 1.0)])) e from {source})"
        for i, c in enumerate(_STRATA)
    )
    labels = ", ".join(
        f"case when len(e{i}.e) < 2 then 'all' when {c} is null then 'missing' else cast(greatest(len(list_filter(e{i}.e,"
        f" lambda v: v < {c})) - 1, 0) as string) end"
        for i, c in enumerate(_STRATA)
    )
    cross = ", ".join(f"e{i}" for i in range(len(_STRATA)))
    return heads, f"strata as (select {source}.*, concat_ws('|', {labels}) stratum from {source}, {cross})"


_HEADS, _TAGGED = _stratum_sql("v_core")


@query("sm_03_colour_strata", f"with {_HEADS}, {_TAGGED} select source_id, stratum from strata")
def sm_03(t):
    core = t.core
    edges = sampling.stratum_edges(core, _STRATA, 4)
    return core.select("source_id", sampling.colour_stratum(edges).alias("stratum"))


_QUOTA = """cnt as (select stratum, count(*) n from strata group by stratum),
    raw as (select *, round(n * {target} / (select sum(n) from cnt), 9) raw from cnt),
    fl as (select *, cast(floor(raw) as bigint) f, round(raw - floor(raw), 9) fr from raw),
    quo as (select stratum, n, f + case when f < n and row_number() over (order by f < n desc, fr desc, stratum)
      <= {target} - (select sum(f) from fl) then 1 else 0 end quota from fl),
    pick as (select s.*, quota, row_number() over (partition by s.stratum order by
      BUCKET(concat('42:', cast(source_id as string))), source_id) place from strata s join quo on quo.stratum = s.stratum)"""


@query(
    "sm_04_stratified_sample",
    f"with {_HEADS}, {_TAGGED}, {_QUOTA.replace('{target}', '1000::double')} select source_id, stratum from pick where place <= quota",
)
def sm_04(t):
    rows = t.core.select("source_id", *_STRATA)
    return sampling.sample_by_strata(rows, target_n=1000, columns=_STRATA).select("source_id", "stratum")


_MODEL = """lab as (select c.source_id, G, BP, RP, cast(c.source_id in (select source_id from v_known where label = 'known_wr') as int) target
    from v_core c)"""


def labelled(t):
    ids = t.known.where("label = 'known_wr'").select("source_id").distinct().withColumn("__p", F.lit(1))
    return t.core.join(ids, "source_id", "left").withColumn("target", F.coalesce("__p", F.lit(0))).drop("__p")


_NEG_HEADS, _NEG_TAGGED = _stratum_sql("neg")


@query(
    "sm_05_reduce_negatives",
    f"""with {_MODEL}, sp as (select *, (BUCKET(concat('42:', cast(source_id as string))) % 10000) < 2000 hold from lab),
    neg as (select * from sp where not hold and target = 0), {_NEG_HEADS}, {_NEG_TAGGED},
    {_QUOTA.replace('{target}', '(select 10e0 * count(*) from sp where not hold and target = 1)')},
    out as (select sp.target, case when hold then 'holdout' when sp.target = 1 or p.source_id is not null then 'train'
      else 'threshold_calibration' end modeling_split, sp.source_id from sp
      left join (select source_id from pick where place <= quota) p on p.source_id = sp.source_id)
    select modeling_split, target, count(*) n, cast(sum(source_id) as bigint) ids from out group by 1, 2""",
)
def sm_05(t):
    reduced = sampling.reduce_negatives(labelled(t).select("source_id", "target", *_STRATA), ratio=10, columns=_STRATA)
    return reduced.groupBy("modeling_split", "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids")
    )


@query(
    "sm_06_stable_sample",
    "select source_id from v_core order by BUCKET(concat('42:', cast(source_id as string))), source_id limit 3000",
)
def sm_06(t):
    return sampling.stable_sample(t.core.select("source_id"), 3000)


def _positive_colours(t):
    ids = t.known.where("label = 'known_wr'").select("source_id").distinct()
    rows = ph.with_colours(t.pool, ("G_BP", "G_RP")).join(ids, "source_id", "left_semi")
    return cut_lineage(rows.select(
        "source_id", ph.signed_log1p(F.col("G_BP")).alias("x"), ph.signed_log1p(F.col("G_RP")).alias("y")
    ).dropna())


@query("sm_07_bootstrap_fits")
def sm_07(t):
    """Slope and intercept of 20 Poisson bootstrap refits."""
    fits = sampling.huber_by_replicate(sampling.bootstrap_weights(_positive_colours(t), 20, 42), "x", "y")
    return t.spark.createDataFrame([(r, m, b) for r, (m, b, _) in fits.items()], "rep int, slope double, intercept double")


@query("sm_07_fold_stability")
def sm_07_folds(t):
    rows = sampling.fold_weights(_positive_colours(t), 5, 42)
    return sampling.fold_stability(rows, "x", "y", sampling.huber_by_replicate(rows, "x", "y"))


def training_rows(t):
    """Reduced training rows with complete features: the input of every sampler."""
    return cut_lineage(
        sampling.reduce_negatives(labelled(t).select("source_id", "target", *_STRATA), ratio=10, columns=_STRATA)
        .where("modeling_split = 'train'")
        .select("source_id", "target", *_STRATA)
        .dropna()
    )


@query("sm_08_smote")
def sm_08(t):
    grown = sampling.resample(training_rows(t), "smote", _STRATA)
    return grown.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count("source_id").alias("originals"), F.min("G").alias("g_min"), F.max("G").alias("g_max")
    )


_TRAIN = f"""{_MODEL}, sp as (select *, (BUCKET(concat('42:', cast(source_id as string))) % 10000) < 2000 hold from lab),
    neg as (select * from sp where not hold and target = 0), {_NEG_HEADS}, {_NEG_TAGGED},
    {_QUOTA.replace('{target}', '(select 10e0 * count(*) from sp where not hold and target = 1)')},
    train as (select sp.target, sp.G, sp.BP, sp.RP from sp left join (select source_id from pick where place <= quota) p
      on p.source_id = sp.source_id where not hold and (sp.target = 1 or p.source_id is not null)
      and sp.G is not null and sp.BP is not null and sp.RP is not null)"""


@query(
    "sm_08_smote_classes",
    f"""with {_TRAIN}, c as (select target, count(*) n, min(G) lo, max(G) hi from train group by target)
    select target, (select max(n) from c) n, n originals, true inside from c""",
)
def sm_08_classes(t):
    """Classes are equal, originals are kept, and synthetic rows stay within the range of their class."""
    rows = training_rows(t)
    grown = sampling.resample(rows, "smote", _STRATA)
    ends = rows.groupBy("target").agg(F.min("G").alias("lo"), F.max("G").alias("hi"))
    made = grown.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count("source_id").alias("originals"), F.min("G").alias("g_min"), F.max("G").alias("g_max")
    )
    inside = (F.col("g_min") >= F.col("lo")) & (F.col("g_max") <= F.col("hi"))
    return made.join(ends, "target").select("target", "n", "originals", inside.alias("inside"))


@query("sm_08_smote_enn")
def sm_08_enn(t):
    return sampling.resample(training_rows(t), "smote_enn", _STRATA).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("sm_08_smote_tomek")
def sm_08_tomek(t):
    return sampling.resample(training_rows(t), "smote_tomek", _STRATA).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sm_08_random_oversample",
    f"""with {_MODEL}, n as (select count(*) filter (where target = 1) p, count(*) filter (where target = 0) q from lab)
    select target, case when target = 1 then (select q from n) else count(*) end n, count(distinct source_id) ids from lab group by target""",
)
def sm_08_random(t):
    grown = sampling.random_oversample(labelled(t).select("source_id", "target"))
    return grown.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("ids"))


_POWER = 18


def _alphas(d=4):
    g = 2.0
    for _ in range(60):
        g = (1.0 + g) ** (1.0 / (d + 1))
    return [(1.0 / g) ** (i + 1) for i in range(d)]


_WIDE_OF = {b.name: b for b in WIDE}


def _slack_sql(b):
    """The slack of one plane; the ends of its first colour are signed logarithms of the observed bounds."""
    over = _WIDE_OF[b.name]
    gap = lambda end: (
        f"abs({b.slope - over.slope!r}::double * (sign({end}_{b.x}) * ln(1 + abs({end}_{b.x}))) + {b.intercept - over.intercept!r}::double)"
    )
    return f"{over.threshold!r}::double - (greatest({gap('lo')}, {gap('hi')}) + {b.threshold!r}::double)"


_BOX_SQL = ", ".join(f"min({c}) lo_{c}, max({c}) hi_{c}" for c in locus.PLANE_COLOURS)
_POINTS_SQL = ", ".join(
    f"lo_{c} + ((0.5::double + i * {a!r}::double) % 1e0) * (hi_{c} - lo_{c}) {c}" for c, a in zip(containment.INDEPENDENT, _alphas())
)
_SIGNED_SQL = ", ".join(f"sign({c}) * ln(1 + abs({c})) t_{c}" for c in locus.PLANE_COLOURS)
_WITNESS_SQL = f"""{COLOUR_SQL}, b as (select {_BOX_SQL} from c), p as (select i id, {_POINTS_SQL}, lo_BP_RP, hi_BP_RP, lo_J_K, hi_J_K
      from range({1 << _POWER}) r(i), b), q as (select *, G_RP - G_BP BP_RP, J_H + H_K J_K from p),
    w as (select *, {_SIGNED_SQL} from q where BP_RP between lo_BP_RP and hi_BP_RP and J_K between lo_J_K and hi_J_K),
    k as (select *, {count_sql(WIDE)} wide_count, least({", ".join(f"abs({margin_sql(b)})" for b in WIDE)}) distance,
      {", ".join(f"{count_sql(bands)} count__{v}" for v, bands in LOCI.items())} from w)"""


def _box(t):
    """The observed bounds of six colours, and the points inside them."""
    colours = ph.with_colours(t.pool, ph.LOCAL_COLOURS)
    found = audits.colour_envelope(colours, locus.PLANE_COLOURS, span_fraction=0.0, absolute={}).collect()  # six rows
    box = {r["colour"]: (r["min"], r["max"]) for r in found}
    return box, containment.box_points(t.spark, _POWER, box)


@query(
    "sm_09_geometric_witnesses",
    f"with {_WITNESS_SQL} " + " union all ".join(
        f"select '{v}' variant, (select {' + '.join(f'case when {_slack_sql(b)} >= -1e-12 then 1 else 0 end' for b in bands)} from b)::bigint "
        f"contained_planes, {len(bands)}::bigint planes, (select round(least({', '.join(_slack_sql(b) for b in bands)}), 9) from b) least_slack, "
        f"count(*) points_inside, count(*) filter (where count__{v} < 2) exact_keep, "
        f"count(*) filter (where count__{v} < 2 and not wide_count < 2) exact_not_aggregate, "
        f"count(*) filter (where count__{v} < 2 and not wide_count < 2) > 0 disproved from k"
        for v, bands in LOCI.items()
    ),
)
def sm_09(t):
    """All exact loci against the aggregate: by their lines over the colour box, and by points filling it."""
    box, points = _box(t)
    return containment.containment_summary(points, LOCI, WIDE, box).withColumn("least_slack", F.round("least_slack", 9))


@query(
    "sm_09_witness_points",
    f"with {_WITNESS_SQL}, x as (" + " union all ".join(
        f"select '{v}' variant, id, count__{v} exact_outlier_planes, wide_count aggregate_outlier_planes, "
        f"round(distance, 9) boundary_distance, round(G_BP, 9) \"G_BP\", round(J_K, 9) \"J_K\" from k where count__{v} < 2 and not wide_count < 2" for v in LOCI
    ) + ") select *, row_number() over (partition by variant order by id) place from x qualify place <= 20",
)
def sm_09_witnesses(t):
    _, points = _box(t)
    return containment.containment_witnesses(points, LOCI, WIDE).select(
        "variant", "id", "exact_outlier_planes", "aggregate_outlier_planes", F.round("boundary_distance", 9).alias("boundary_distance"),
        F.round("G_BP", 9).alias("G_BP"), F.round("J_K", 9).alias("J_K"), "place",
    )
