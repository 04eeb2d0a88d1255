"""Predicate and set-operation queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from raresift.functions import photometry as ph, text
from raresift.operators import dedup, filters
from raresift.operators.ranking import has_bit
from raresift.plans.registry import query

REQUIRED = ["source_id", "ra", "dec", "G", "BP", "RP", "J", "H", "Ks", "W1", "W2"]
_NOT_NULL = " and ".join(f'"{c}" is not null' for c in REQUIRED)


def _letters(column, positions, allowed):
    return " and ".join(f"substr({column}, {p + 1}, 1) in {allowed}" for p in positions)


def quality_sql(family):
    allowed = "('A')" if family == "strict" else "('A', 'B')"
    return f"{_letters('tmass_quality', range(3), allowed)} and {_letters('wise_quality', range(2), allowed)}"


@query(
    "flt_01_family_quality",
    f"""select source_id, 'strict' dataset_family from v_pool where {_NOT_NULL} and {quality_sql('strict')}
    union all select source_id, 'relaxed' from v_pool where {_NOT_NULL} and {quality_sql('relaxed')}""",
)
def flt_01(t):
    families = F.array(*[
        F.when(ph.photometry_ok(REQUIRED, allowed, allowed), family) for family, allowed in ph.FAMILIES.items()
    ])
    spread = t.pool.select("source_id", F.explode(families).alias("dataset_family"))
    return spread.where(F.col("dataset_family").isNotNull())


@query(
    "flt_02_quality_prefix",
    f"select source_id from v_pool where {_NOT_NULL} and tmass_quality like 'AA%' and wise_quality like 'A%'",
)
def flt_02(t):
    return t.pool.where(ph.quality_prefix_ok(REQUIRED, "AA", "A")).select("source_id")


@query(
    "flt_03_parallax",
    """select source_id, k from v_core, (values (0), (1), (2), (3), (5)) v(k)
    where parallax > 0 and (k = 0 or parallax_over_error >= k)""",
)
def flt_03(t):
    levels = [F.when(ph.parallax_ok(0.0, float(k) if k else None), F.lit(k)) for k in (0, *ph.POE_LEVELS)]
    spread = t.core.select("source_id", F.explode(F.array(*levels)).alias("k"))
    return spread.where(F.col("k").isNotNull())


def astrometry_sql(subset):
    if subset == "photometry":
        return "true"
    floor = "" if subset == "parallax_soft" else f" and parallax_over_error >= {subset[4:]}"
    return f"coalesce(parallax > 0{floor}, false)"


@query(
    "flt_04_variant_rules",
    "select source_id, "
    + ", ".join(f"coalesce({quality_sql(f)}, false) quality__{f}" for f in ph.FAMILIES)
    + ", "
    + ", ".join(f"{astrometry_sql(s)} astrometry__{s}" for s in ph.SUBSETS)
    + " from v_pool",
)
def flt_04(t):
    rules = [ph.variant_photometry(f"{f}_photometry").alias(f"quality__{f}") for f in ph.FAMILIES]
    rules += [ph.variant_astrometry(f"strict_{s}").alias(f"astrometry__{s}") for s in ph.SUBSETS]
    return t.pool.select("source_id", *rules)


@query(
    "flt_05_band_availability",
    f"""select source_id, J is not null and W1 is not null and G is not null and BP is not null and RP is not null
      and coalesce({_letters('tmass_quality', [0], "('A')")}, false)
      and coalesce({_letters('wise_quality', [0], "('A')")}, false) ok_a,
      H is not null and W2 is not null and coalesce({_letters('tmass_quality', [1], "('A', 'B')")}, false)
      and coalesce({_letters('wise_quality', [1], "('A', 'B')")}, false) ok_b from v_pool""",
)
def flt_05(t):
    return t.pool.select(
        "source_id",
        ph.bands_available(["J", "W1"], "A").alias("ok_a"),
        ph.bands_available(["H", "W2"], "B", require_optical=False).alias("ok_b"),
    )


BOUNDS = {"G_BP": (-4.0, 3.5), "J_H": (-5.0, 5.0), "W1_W2": (-6.0, 6.0)}
PLANES = [
    {"x": "G_BP", "y": "G_RP", "slope_min": 0.6, "slope_max": 1.1, "intercept_min": -0.3, "intercept_max": 0.2,
     "threshold_max": 0.4},
    {"x": "J_H", "y": "J_K", "slope_min": 0.5, "slope_max": 0.9, "intercept_min": -0.1, "intercept_max": 0.3,
     "threshold_max": 0.5},
]
COLOUR_SQL = """c as (select *, G - BP G_BP, G - RP G_RP, BP - RP BP_RP, J - H J_H, J - Ks J_K, H - Ks H_K, W1 - W2 W1_W2
    from v_pool)"""


@query(
    "flt_06_colour_bounds",
    f"with {COLOUR_SQL} select source_id from c where "
    + " and ".join(f"{n} between {lo}::double and {hi}::double" for n, (lo, hi) in BOUNDS.items()),
)
def flt_06(t):
    return ph.with_colours(t.pool, ph.LOCAL_COLOURS).where(ph.within_bounds(BOUNDS)).select("source_id")


def signed(name):
    return f"(sign({name}) * ln(1 + abs({name})))"


def _corner_sql():
    corners = []
    for p in PLANES:
        for m in (p["slope_min"], p["slope_max"]):
            for b in (p["intercept_min"], p["intercept_max"]):
                corners.append(
                    f"abs({signed(p['y'])} - ({b}::double + {m}::double * {signed(p['x'])})) <= {p['threshold_max']}::double"
                )
    return " or ".join(corners)


@query("flt_07_locus_corners", f"with {COLOUR_SQL} select source_id from c where {_corner_sql()}")
def flt_07(t):
    return ph.with_colours(t.pool, ph.LOCAL_COLOURS).where(ph.near_any_plane(PLANES)).select("source_id")


@query(
    "flt_08_quality_letters",
    "select source_id from v_pool where "
    + " or ".join(f"tmass_quality like '{a}{b}{c}%'" for a in "AB" for b in "AB" for c in "AB"),
)
def flt_08(t):
    return t.pool.where(ph.quality_letters("tmass_quality", "AB", 3)).select("source_id")


@query(
    "flt_09_astrometry_cut",
    "select source_id from v_core where parallax > 0.5 and parallax_over_error >= 3",
)
def flt_09(t):
    return t.core.where((F.col("parallax") > 0.5) & (F.col("parallax_over_error") >= 3)).select("source_id")


@query(
    "flt_10_exclude_types",
    """select source_id from v_ident where not regexp_matches(concat(coalesce(main_type, ''), ' ',
        coalesce(spectral_type, '')), '(?i)\\bwr\\*|wolf-?rayet|wn\\s*5')
      and source_id not in (select source_id from v_label where target = 1)""",
)
def flt_10(t):
    return filters.exclude_types(
        t.ident,
        known_ids=t.label.where("target = 1").select("source_id"),
        columns=["main_type", "spectral_type"],
        tokens=["WR*", "wolf-rayet", "wn 5"],
    ).select("source_id")


@query("flt_11_variant_bit", "select source_id from v_elig where (coalesce(compatible_mask, 0) & 256) <> 0")
def flt_11(t):
    return t.elig.where(has_bit("compatible_mask", 8)).select("source_id")


@query(
    "flt_12_locus_keep",
    f"""with {COLOUR_SQL}, k as (select source_id, coalesce({_corner_sql()}, false) color_locus_keep from c)
    select color_locus_keep kept, count(*) n from k group by 1""",
)
def flt_12(t):
    df = ph.with_colours(t.pool, ph.LOCAL_COLOURS).withColumn(
        "color_locus_keep", F.coalesce(ph.near_any_plane(PLANES), F.lit(False))
    )
    return filters.keep_counts(df)


@query(
    "flt_13_facets",
    """select result_id from v_results where coalesce(sampler, 'missing') in ('missing', 'smote')
      and coalesce(feature_set, 'missing') in ('missing', 'promo', 'large') and model in ('xgboost')
      and selection_status = 'accepted'""",
)
def flt_13(t):
    facets = {"sampler": ["missing", "smote"], "feature_set": ["missing", "promo", "large"], "model": ["xgboost"]}
    return filters.by_facets(t.results, facets, accepted_only=True).select("result_id")


@query(
    "flt_14_complete_cases",
    """select source_id, G, BP, RP, J, H, Ks, W1 from v_pool where G is not null and BP is not null and RP is not null
      and J is not null and H is not null and Ks is not null and W1 is not null""",
)
def flt_14(t):
    return filters.model_matrix(t.pool, ["G", "BP", "RP", "J", "H", "Ks", "W1"])


@query(
    "flt_15_cohort",
    """with k as (select l.*, l.target = 0 or i.source_id is not null kept from v_label l
      left join (select source_id from v_ident where other_types in ('en', 'de')) i on i.source_id = l.source_id)
    select count(*) filter (where target = 1) positives_before, count(*) filter (where target = 1 and kept) positives_after,
      count(*) filter (where target = 0) negatives_before, count(*) filter (where target = 0 and kept) negatives_after
    from k""",
)
def flt_15(t):
    cohort = t.ident.where(F.col("other_types").isin("en", "de")).select("source_id")
    return filters.cohort_counts(filters.tag_cohort(t.label, cohort))


_PRESETS = """ranked as (select *, row_number() over (partition by result_id order by score desc, source_id) rank,
    cast(score >= threshold as int) predicted from v_pred)"""


@query(
    "flt_16_review_subsets",
    f"""with {_PRESETS} select result_id, count(*) filter (where rank <= 50) top_k,
      count(*) filter (where target = 0 and rank <= 50) contaminants,
      count(*) filter (where target = 1 and rank > 50) outside,
      count(*) filter (where target = 0 and predicted = 1) false_positives,
      count(*) filter (where target = 1 and predicted = 0) false_negatives,
      count(*) filter (where target = 1) positives from ranked group by result_id""",
)
def flt_16(t):
    from raresift.operators.ranking import with_top_rank

    ranked = with_top_rank(
        t.pred, by=["result_id"], order=[F.desc("score"), F.asc("source_id")], limit=50
    ).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return ranked.groupBy("result_id").agg(
        *[F.count_if(rule).alias(name) for name, rule in filters.review_subsets(50).items()]
    )


@query(
    "flt_17_lineage_match",
    """with p as (select * from v_results where selection_status = 'accepted'
        order by holdout_average_precision desc nulls last, result_id limit 1)
    select p.result_id parent_id, l.result_id layer_id from p, v_results l where l.selection_status = 'accepted'
        and l.model = p.model and (p.feature_set is null or l.feature_set = p.feature_set)
        and (p.sampler is null or l.sampler = p.sampler)""",
)
def flt_17(t):
    parent = (
        t.results.where("selection_status = 'accepted'")
        .orderBy(F.desc_nulls_last("holdout_average_precision"), "result_id")
        .limit(1)
    )
    return filters.lineage_compatible(
        parent, t.results, keys=["model"], tolerant=["feature_set", "sampler"]
    ).select("parent_id", "layer_id")


@query(
    "flt_18_ranking_view",
    """select result_id, n_holdout from v_results where hits_at_100 >= 5 and feature_set in ('promo', 'large', 'medium')
      and selection_status not in ('overfit_warning') and holdout_average_precision is not null
      order by holdout_average_precision desc, result_id limit 500""",
)
def flt_18(t):
    return filters.ranking_view(
        t.results,
        support="hits_at_100",
        min_support=5,
        category="feature_set",
        categories=["promo", "large", "medium"],
        closed={"selection_status": ["overfit_warning"]},
        evidence="holdout_average_precision",
        order=[F.desc("holdout_average_precision"), F.asc("result_id")],
        limit=500,
    ).select("result_id", "n_holdout")


@query(
    "flt_19_annotate_all",
    """select count(*) n_rows, count(distinct source_id) n_ids, count(*) filter (where known is not null) n_known,
      count(*) filter (where (compatible_mask & 259) <> 0) n_pass from v_elig e left join
      (select source_id, min(label) known from v_known group by source_id) k using (source_id)""",
)
def flt_19(t):
    known = t.known.groupBy("source_id").agg(F.min("label").alias("known"))
    annotated = filters.annotate_acquisition(t.elig, known, required=["source_id", "compatible_mask"])
    return annotated.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("source_id").alias("n_ids"),
        F.count("known").alias("n_known"),
        F.count_if(F.col("compatible_mask").bitwiseAND(F.lit(259)) != 0).alias("n_pass"),
    )


# ---- set operations -------------------------------------------------------


@query(
    "set_01_union_by_name",
    """select source_id, target, quality, cast(null as string) spectral_type, 'labels' dataset_variant from v_label
    union all by name select source_id, 0 target, spectral_type, 'ident' dataset_variant from v_ident
      where spectral_type is null""",
)
def set_01(t):
    positives = t.label.withColumn("dataset_variant", F.lit("labels"))
    negatives = t.ident.where("spectral_type is null").select(
        "source_id", F.lit(0).alias("target"), "spectral_type", F.lit("ident").alias("dataset_variant")
    )
    return positives.unionByName(negatives, allowMissingColumns=True)


@query(
    "set_02_union_one_per_id",
    """select source_id, G, origin from (select *, row_number() over (partition by source_id order by origin, G) rn from
      (select source_id, G, 1 origin from v_core where parallax > 0 union all
       select source_id, G, 2 from v_core where ruwe > 1.2)) where rn = 1""",
)
def set_02(t):
    first = t.core.where("parallax > 0").select("source_id", "G", F.lit(1).alias("origin"))
    second = t.core.where("ruwe > 1.2").select("source_id", "G", F.lit(2).alias("origin"))
    return dedup.first_per_key(first.unionByName(second), ["source_id"], ["origin", "G"])


_A, _B = "select source_id from v_core where parallax > 0", "select source_id from v_core where ruwe > 1.2"


@query("set_03_intersect_union", f"""with i as (({_A}) intersect ({_B})), u as (({_A}) union ({_B}))
    select 'both' kind, count(*) n, cast(sum(source_id) as bigint) ids from i
    union all select 'any', count(*), cast(sum(source_id) as bigint) from u""")
def set_03(t):
    a, b = t.core.where("parallax > 0").select("source_id"), t.core.where("ruwe > 1.2").select("source_id")
    frames = {"both": a.intersect(b), "any": a.union(b).distinct()}
    return functools.reduce(
        lambda x, y: x.unionByName(y),
        [
            df.agg(F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids")).select(F.lit(k).alias("kind"), "n", "ids")
            for k, df in frames.items()
        ],
    )


@query("set_04_except", f"""select 'a_minus_b' side, source_id from (({_A}) except ({_B}))
    union all select 'b_minus_a', source_id from (({_B}) except ({_A}))""")
def set_04(t):
    a, b = t.core.where("parallax > 0").select("source_id"), t.core.where("ruwe > 1.2").select("source_id")
    return (
        a.subtract(b).select(F.lit("a_minus_b").alias("side"), "source_id")
        .unionByName(b.subtract(a).select(F.lit("b_minus_a").alias("side"), "source_id"))
    )
