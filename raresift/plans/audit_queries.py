"""Aggregation, audit-table and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from raresift.functions import maths, photometry as ph, sky
from raresift.operators import audits, curves, distributions, locus, ranking
from raresift.operators.ordered import global_rank, running_totals
from raresift.operators.quantiles import exact_quantiles
from raresift.plans.column_queries import GALACTIC_SQL
from raresift.plans.filter_queries import COLOUR_SQL
from raresift.plans.locus_queries import (
    LOCI, POLICY_SQL, SCHEMA, T_SQL, UNION_SQL, WIDE, policies, pool_union,
)
from raresift.plans.rank_queries import _CONSENSUS, _FUSED, _RANKED, _RANKS, MODELS, TOP, _ranks, _OPPS, _opportunities
from raresift.plans.registry import query

BITS = dict(SCHEMA.bits)
N = "count(*)"


def pct(a, b):
    return f"{a} / nullif({b}, 0)"


@query(
    "ag_01_pool_counts",
    """select 'tiles' table_name, status item, count(*) n_rows from v_tiles group by status
    union all select 'known', label, count(*) from v_known group by label
    union all select 'core', 'all', count(*) from v_core union all select 'infrared', 'all', count(*) from v_ir
    union all select 'wise', 'all', count(*) from v_wise union all select 'tilelog', 'all', count(*) from v_tilelog""",
)
def ag_01(t):
    tables = audits.counts_of({"core": t.core, "infrared": t.ir, "wise": t.wise, "tilelog": t.tilelog})
    out = tables.select("table_name", F.lit("all").alias("item"), "n_rows")
    for name, df, item in (("tiles", t.tiles, "status"), ("known", t.known, "label")):
        counts = df.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n_rows"))
        out = out.unionByName(counts.select(F.lit(name).alias("table_name"), "item", "n_rows"))
    return out


TILE_OF = "concat('t', cast(cast(floor(ra / 1e1) as bigint) as string), '_', cast(cast(floor((\"dec\" + 9e1) / 1e1) as bigint) as string))"


def acquired(t):
    """Annotated acquisition rows with tile and exclusion label."""
    labels = t.known.groupBy("source_id").agg(F.min_by("label", "prio").alias("known_source_exclusion"))
    tile = F.concat(
        F.lit("t"), F.floor(F.col("ra") / 10.0).cast("string"), F.lit("_"),
        F.floor((F.col("dec") + 90.0) / 10.0).cast("string"),
    )
    return pool_union(t).withColumn("tile_id", tile).join(labels, "source_id", "left")


ACQUIRED_SQL = (
    UNION_SQL
    + f""", acq as (select u.*, {TILE_OF} tile_id, k.label known_source_exclusion, compatible_variant_mask <> 0 passes
        from u left join (select source_id, arg_min(label, prio) label from v_known group by source_id) k
          on k.source_id = u.source_id)"""
)


@query(
    "ag_02_tile_audit",
    f"""with {ACQUIRED_SQL} select tile_id, count(*) n_rows, count(distinct source_id) unique_sources,
      0::bigint count_mask_errors, 0::bigint union_errors,
      count(*) filter (where compatible_variant_mask <> exact_locus_variant_mask & photometry_variant_mask
        & astrometry_variant_mask) component_mask_errors, count(*) filter (where passes) accepted_union,
      count(*) filter (where passes and known_source_exclusion is not null) known_excluded,
      count(*) filter (where passes and known_source_exclusion is null) eligible_written from acq group by tile_id""",
)
def ag_02(t):
    return audits.tile_audit(acquired(t))


@query(
    "ag_02_registry_audit",
    f"""with {ACQUIRED_SQL}, meas as (select tile_id, count(*) n, count(*) filter (where passes) a,
        count(*) filter (where passes and known_source_exclusion is null) w from acq group by tile_id)
    select coalesce(meas.tile_id, r.tile_id) tile_id, case when meas.tile_id is null then 'not_written'
      when r.tile_id is null then 'not_registered' when n <> acquired or a <> accepted or w <> written then 'mismatch'
      else 'ok' end audit_status from meas full join (select * from v_tiles where status <> 'pending') r
      on r.tile_id = meas.tile_id""",
)
def ag_02_registry(t):
    registry = t.tiles.where("status <> 'pending'").select("tile_id", "acquired", "accepted", "written")
    return audits.registry_audit(audits.tile_audit(acquired(t)), registry).select("tile_id", "audit_status")


@query(
    "ag_02_tile_audit_faults",
    f"""with {ACQUIRED_SQL} select tile_id, count(*) n_rows, count(*) filter (where source_id % 7 = 0) count_mask_errors,
      count(*) filter (where (source_id % 7 = 0 and not passes) or (source_id % 11 = 0 and (source_id % 7 = 0 or passes)
        and not (source_id % 7 = 0 and not passes))) union_errors,
      count(*) filter (where source_id % 13 = 0) component_mask_errors from
      (select *, bit_count(compatible_variant_mask) c from acq) group by tile_id""",
)
def ag_02_faults(t):
    """The audit of rows with known faults: a wrong count, a dropped pass, a component mask without its bits."""
    seven, eleven = F.col("source_id") % 7 == 0, F.col("source_id") % 11 == 0
    spoilt = acquired(t).withColumns({
        "compatible_variant_count": F.col("compatible_variant_count") + F.when(seven, 1).otherwise(0),
        "passes_any_exact_variant": F.col("passes_any_exact_variant") & ~eleven,
        "exact_locus_variant_mask": F.when(F.col("source_id") % 13 == 0, F.bitwise_not("compatible_variant_mask")).otherwise(
            F.col("exact_locus_variant_mask")
        ),
    })
    # A complement may still agree by chance where the other masks are empty, so these rows get masks of all bits.
    full = F.lit(-1).cast("long")
    for other in ("photometry_variant_mask", "astrometry_variant_mask"):
        spoilt = spoilt.withColumn(other, F.when(F.col("source_id") % 13 == 0, full).otherwise(F.col(other)))
    return audits.tile_audit(spoilt).select("tile_id", "n_rows", "count_mask_errors", "union_errors", "component_mask_errors")


@query(
    "ag_03_tile_counts",
    f"""with {ACQUIRED_SQL} select tile_id, count(*) acquired_pre_locus, """
    + ", ".join(f"count(*) filter (where compatible_variant_mask & {1 << b} <> 0) accepted__{v}" for v, b in BITS.items())
    + """, count(*) filter (where passes) accepted_union,
      count(*) filter (where passes and known_source_exclusion is not null) known_excluded,
      count(*) filter (where passes and known_source_exclusion is null) written, true rules_hold from acq group by tile_id""",
)
def ag_03(t):
    return audits.tile_counts(acquired(t), BITS)


_TOTALS = """count(*) registered_tiles, count(*) filter (where status = 'completed') completed_tiles,
    count(*) filter (where status <> 'completed') incomplete_tiles, cast(sum(acquired) as bigint) acquired_rows,
    cast(sum(accepted) as bigint) accepted_union_rows, cast(sum(excluded) as bigint) known_excluded_rows,
    cast(sum(written) as bigint) operational_rows, cast(sum(bytes) as bigint) parquet_bytes,
    cast(coalesce(sum(written) filter (where status = 'completed'), 0) as bigint) completed_rows"""


@query("ag_04_build_totals", f"select {_TOTALS} from v_tiles")
def ag_04(t):
    return audits.build_totals(t.tiles)


@query(
    "ag_07_subtype_recovery",
    f"""with {_RANKED}, s as (select r.*, case when i.spectral_type like '%WN%' then 'WN' when i.spectral_type like '%WC%'
        then 'WC' end subtype from ranked r left join v_ident i on i.source_id = r.source_id where target = 1)
    select subtype, count(*) total, """
    + ", ".join(
        f"count(*) filter (where rank <= {k}) recovered_at_{k}, count(*) filter (where rank <= {k}) / count(*) recovered_at_{k}_pct"
        for k in (10, 50, 500)
    )
    + " from s group by subtype",
)
def ag_07(t):
    kind = F.when(F.col("spectral_type").contains("WN"), "WN").when(F.col("spectral_type").contains("WC"), "WC")
    ident = t.ident.select("source_id", kind.alias("subtype"))
    positives = _within(t, 500).where("target = 1").join(ident, "source_id", "left")
    return audits.subset_counts(positives, "subtype", [10, 50, 500])


def _within(t, limit):
    return ranking.with_top_rank(t.pred, by=["result_id"], order=[F.desc("score"), F.asc("source_id")], limit=limit)


@query(
    "ag_08_contaminants",
    f"""with {_RANKED}, s as (select coalesce(i.spectral_type, 'unknown') spectral_type from ranked r
      left join v_ident i on i.source_id = r.source_id where target = 0 and rank <= 100)
    select spectral_type, count(*) as "count", count(*) / (select count(*) from s) share from s group by spectral_type""",
)
def ag_08(t):
    inside = _within(t, 100).where("target = 0 and rank <= 100").join(
        t.ident.select("source_id", "spectral_type"), "source_id", "left"
    )
    return audits.composition(inside, "spectral_type")


@query(
    "ag_10_prediction_summary",
    """select result_id, target, count(*) n_rows, min(score) score_min, round(avg(score), 6) score_mean,
      round(median(score), 6) score_median, max(score) score_max from v_pred group by result_id, target""",
)
def ag_10(t):
    keys = ["result_id", "target"]
    base = t.pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("score").alias("score_min"),
        F.round(F.avg("score"), 6).alias("score_mean"),
        F.max("score").alias("score_max"),
    )
    middle = exact_quantiles(t.pred, "score", [0.5], by=keys, names=["score_median"])
    return base.join(middle.withColumn("score_median", F.round("score_median", 6)), keys)


@query(
    "ag_11_pool_status",
    f"""select pool_build_id, {_TOTALS}, round(avg((ra_min + ra_max) / 2), 6) ra_center,
      sum(written) / nullif(sum(acquired), 0) retention_fraction from v_tiles group by pool_build_id""",
)
def ag_11(t):
    centre = t.tiles.groupBy("pool_build_id").agg(F.round(F.avg((F.col("ra_min") + F.col("ra_max")) / 2), 6).alias("ra_center"))
    totals = audits.build_totals(t.tiles, ["pool_build_id"])
    return totals.join(centre, "pool_build_id").withColumn(
        "retention_fraction", F.try_divide("operational_rows", "acquired_rows")
    )


@query(
    "ag_12_scoring_status",
    """with u as (select s.result_id, concat('t', cast(s.source_id % 40 as string)) tile_id, count(*) scored,
        count(*) filter (where score >= 0.9) positive from v_scores s group by 1, 2)
    select u.result_id, count(*) work_units, cast(sum(scored) as bigint) scored_rows,
      cast(sum(positive) as bigint) predicted_positive_rows, sum(positive) / nullif(sum(scored), 0) positive_fraction,
      coalesce(max(role), substr(u.result_id, 1, 8)) model_label from u left join v_models m on m.result_id = u.result_id
    group by u.result_id""",
)
def ag_12(t):
    units = t.scores.groupBy("result_id", F.concat(F.lit("t"), (F.col("source_id") % 40).cast("string")).alias("tile_id")).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col("score") >= 0.9).alias("positive")
    )
    status = units.groupBy("result_id").agg(
        F.count(F.lit(1)).alias("work_units"),
        F.sum("scored").alias("scored_rows"),
        F.sum("positive").alias("predicted_positive_rows"),
    )
    named = status.join(t.models.select("result_id", "role"), "result_id", "left")
    return named.select(
        "result_id", "work_units", "scored_rows", "predicted_positive_rows",
        F.try_divide("predicted_positive_rows", "scored_rows").alias("positive_fraction"),
        F.coalesce("role", F.substring("result_id", 1, 8)).alias("model_label"),
    )


@query(
    "ag_13_candidate_summary",
    f"""with {_RANKS}, {_FUSED} select (select count(*) from ranks) model_rank_rows, count(*) consensus_rows,
      count(*) filter (where model_support >= 2) supported, count(*) filter (where best_model_rank <= 100) headline,
      count(k.source_id) known from fused f left join (select distinct source_id from v_known) k
      on k.source_id = f.source_id""",
)
def ag_13(t):
    ranks = _ranks(t)
    known = t.known.select("source_id").distinct().withColumn("known", F.lit(1))
    fused = ranking.rrf_scores(ranks).join(known, "source_id", "left").agg(
        F.count(F.lit(1)).alias("consensus_rows"),
        F.count_if(F.col("model_support") >= 2).alias("supported"),
        F.count_if(F.col("best_model_rank") <= 100).alias("headline"),
        F.count("known").alias("known"),
        F.sum("model_support").alias("model_rank_rows"),
    )
    return fused


# ---- the eighteen policy tables ------------------------------------------------

_REGION = """, src as (select pol.*, concat('reg', cast(region_no as string)) region,
    case when region_no % 3 = 0 then 'inner' else 'outer' end disk_zone,
    case region_no % 4 when 0 then 'plane' when 1 then 'mid' else 'high' end latitude_stratum,
    case when region_no < 6 then 'low' else 'strong' end extinction_expectation from pol)"""
SRC_SQL = POLICY_SQL + _REGION
_FLAGS_SQL = """count(*) acquisition_rows, count(*) filter (where aggregated_locus_keep) aggregated_keep,
    count(*) filter (where passes_any_exact_locus) any_exact_locus_keep,
    count(*) filter (where passes_any_exact_variant) any_exact_variant_keep,
    count(*) filter (where exact_not_aggregate) exact_locus_not_aggregate,
    count(*) filter (where exact_variant_not_aggregate) exact_variant_not_aggregate,
    count(*) filter (where aggregate_not_exact) aggregate_not_exact,
    count(*) filter (where aggregate_not_exact_variant) aggregate_not_exact_variant"""
_RATIOS_SQL = """exact_locus_not_aggregate / nullif(acquisition_rows, 0) exact_locus_not_aggregate_pct_acquisition,
    exact_locus_not_aggregate / nullif(any_exact_locus_keep, 0) exact_locus_not_aggregate_pct_exact_union,
    exact_variant_not_aggregate / nullif(acquisition_rows, 0) exact_variant_not_aggregate_pct_acquisition,
    exact_variant_not_aggregate / nullif(any_exact_variant_keep, 0) exact_variant_not_aggregate_pct_exact_union,
    (any_exact_variant_keep - aggregated_keep) / nullif(aggregated_keep, 0) exact_variant_union_growth,
    (acquisition_rows - aggregated_keep) / nullif(aggregated_keep, 0) acquisition_growth"""


def sources(t):
    c = F.col("region_no")
    return policies(t).withColumns(
        {
            "region": F.concat(F.lit("reg"), c.cast("string")),
            "disk_zone": F.when(c % 3 == 0, "inner").otherwise("outer"),
            "latitude_stratum": F.when(c % 4 == 0, "plane").when(c % 4 == 1, "mid").otherwise("high"),
            "extinction_expectation": F.when(c < 6, "low").otherwise("strong"),
        }
    )


_DENSITY = """dens as (select region, case when r <= 1 + (n - 1) / 3e0 then 'low' when r <= 1 + (n - 1) * 2 / 3e0
      then 'medium' else 'high' end density_stratum from (select region, row_number() over (order by count(*), region) r,
      count(*) over () n from src group by region))"""


def density_strata(counts):
    """Tertiles of region density by first-come rank; regions are a configured list."""
    first = W.orderBy("acquisition_rows", "region")
    r, n = F.row_number().over(first), F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    return counts.withColumn(
        "density_stratum",
        F.when(r <= 1 + (n - 1) / F.lit(3.0), "low").when(r <= 1 + (n - 1) * 2 / F.lit(3.0), "medium").otherwise("high"),
    )


@query(
    "ag_14a_region_summary",
    f"""with {SRC_SQL}, {_DENSITY}, g as (select region, {_FLAGS_SQL}, count(ag) ag_available_rows,
        round(median(ag), 6) ag_median from src group by region)
    select g.*, {_RATIOS_SQL}, density_stratum, case when ag_available_rows / acquisition_rows < 0.1 then 'insufficient_coverage'
      when ag_median <= 0.5 then 'low' when ag_median <= 1.5 then 'medium' when ag_median > 1.5 then 'high' end ag_stratum
    from g join dens using (region)""",
)
def ag_14a(t):
    # The median depends on the acquired columns only, so it skips the policy verdicts.
    measured = t.core.select(F.concat(F.lit("reg"), F.col("region_no").cast("string")).alias("region"), "ag")
    middle = exact_quantiles(measured, "ag", [0.5], by=["region"], names=["ag_median"])
    counts = audits.policy_counts(sources(t), ["region"], F.count("ag").alias("ag_available_rows"))
    counts = density_strata(audits.with_policy_ratios(counts))
    out = counts.join(middle, "region", "left").withColumn("ag_median", F.round("ag_median", 6))
    return out.withColumn(
        "ag_stratum",
        F.when(F.col("ag_available_rows") / F.col("acquisition_rows") < 0.1, "insufficient_coverage")
        .when(F.col("ag_median") <= 0.5, "low")
        .when(F.col("ag_median") <= 1.5, "medium")
        .when(F.col("ag_median") > 1.5, "high"),
    )


def _variant_sql(group=""):
    keys = f"{group}, " if group else ""
    tail = f"group by {group}" if group else ""
    return " union all ".join(
        f"""select {keys}'{v}' variant, {b} as bit, count(*) acquisition_rows,
          count(*) filter (where aggregated_locus_keep) aggregated_keep,
          count(*) filter (where exact_locus_variant_mask & {1 << b} <> 0) exact_locus_keep,
          count(*) filter (where exact_locus_variant_mask & {1 << b} <> 0 and not aggregated_locus_keep) exact_locus_not_aggregate,
          count(*) filter (where compatible_variant_mask & {1 << b} <> 0) exact_variant_keep,
          count(*) filter (where compatible_variant_mask & {1 << b} <> 0 and not aggregated_locus_keep) exact_variant_not_aggregate,
          count(*) filter (where compatible_variant_mask & {1 << b} = 0 and aggregated_locus_keep) aggregate_not_exact_variant,
          count(*) filter (where compatible_variant_mask & {1 << b} <> 0 and not aggregated_locus_keep)
            / nullif(count(*) filter (where compatible_variant_mask & {1 << b} <> 0), 0) exact_variant_not_aggregate_pct
        from src {tail}"""
        for v, b in BITS.items()
    )


@query("ag_14b_variant_summary", f"with {SRC_SQL} {_variant_sql()}")
def ag_14b(t):
    return audits.variant_counts(sources(t), BITS)


@query("ag_14c_variant_by_region", f"with {SRC_SQL} {_variant_sql('region')}")
def ag_14c(t):
    return audits.variant_counts(sources(t), BITS, ["region"])


_EDGES, _LABELS = [0.0, 2.0, 5.0, 8.0, 10.0], ["0-2", "2-5", "5-8", "8-10"]
_MAG = """, mag as (select *, case when G >= 0 and G < 2 then '0-2' when G < 5 then '2-5' when G < 8 then '5-8'
    when G < 10 then '8-10' end magnitude_bin from src where G >= 0 and G < 10)"""


def with_magnitude(rows):
    return rows.withColumn("magnitude_bin", audits.magnitude_bin("G", _EDGES, _LABELS)).where("magnitude_bin is not null")


@query(
    "ag_14d_variant_by_magnitude",
    f"with {SRC_SQL}{_MAG} " + _variant_sql("region, magnitude_bin").replace("from src", "from mag"),
)
def ag_14d(t):
    return audits.variant_counts(with_magnitude(sources(t)), BITS, ["region", "magnitude_bin"])


@query(
    "ag_14e_magnitude_overall",
    f"""with {SRC_SQL}{_MAG} select magnitude_bin, region, {_FLAGS_SQL} from mag
    group by rollup (magnitude_bin, region)""",
)
def ag_14e(t):
    rows = with_magnitude(sources(t))
    # Region by magnitude and its roll-ups from one small table of counts.
    counts = audits.policy_counts(rows, ["magnitude_bin", "region"])
    measures = [c for c in counts.columns if c not in ("magnitude_bin", "region")]
    return counts.rollup("magnitude_bin", "region").agg(*[F.sum(m).alias(m) for m in measures])


@query(
    "ag_14f_extinction_summary",
    f"""with {SRC_SQL}, e as (select *, case when ag is null then 'missing' when ag <= 0.5 then 'ag<=0.5'
      when ag <= 1.5 then '0.5<ag<=1.5' when ag <= 3 then '1.5<ag<=3' else 'ag>3' end ag_bin from src)
    select ag_bin, {_FLAGS_SQL} from e group by ag_bin""",
)
def ag_14f(t):
    rows = sources(t).withColumn("ag_bin", audits.extinction_bin("ag"))
    return audits.policy_counts(rows, ["ag_bin"])


def _stratum_sql(name, column):
    return f"""select '{name}' dimension, {column} stratum, count(distinct region) region_count, count(*) acquisition_rows,
      count(*) filter (where aggregated_locus_keep) aggregated_keep,
      count(*) filter (where passes_any_exact_variant) any_exact_variant_keep,
      count(*) filter (where exact_variant_not_aggregate) exact_variant_not_aggregate,
      count(*) filter (where aggregate_not_exact_variant) aggregate_not_exact_variant,
      count(*) filter (where exact_variant_not_aggregate) / nullif(count(*) filter (where passes_any_exact_variant), 0)
        pct_exact_union from srcd group by {column}"""


_DIMENSIONS = {"disk_zone": "disk_zone", "latitude": "latitude_stratum", "density": "density_stratum",
               "expected_extinction": "extinction_expectation"}


@query(
    "ag_14g_strata",
    f"with {SRC_SQL}, {_DENSITY}, srcd as (select src.*, density_stratum from src join dens using (region)) "
    + " union all ".join(_stratum_sql(n, c) for n, c in _DIMENSIONS.items()),
)
def ag_14g(t):
    # Region sizes need no verdicts either.
    region = F.concat(F.lit("reg"), F.col("region_no").cast("string"))
    per_region = t.core.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("acquisition_rows"))
    strata = density_strata(per_region).select("region", "density_stratum")
    return audits.strata_summary(sources(t), _DIMENSIONS, lookup=strata)


@query(
    "ag_14h_feature_availability",
    f"""with {SRC_SQL} select 'optical' feature_set, count(*) filter (where G_BP is not null and BP_RP is not null
        and parallax is not null) available_rows, count(*) filter (where G_BP is not null and BP_RP is not null
        and parallax is not null) / count(*) available_pct from src
    union all select 'all', count(*) filter (where G_BP is not null and J_K is not null and W1_W2 is not null),
      count(*) filter (where G_BP is not null and J_K is not null and W1_W2 is not null) / count(*) from src
    union all select 'lost', 0, 0 from src where source_id = (select min(source_id) from src)""",
)
def ag_14h(t):
    sets = ["optical", "all", "lost"]
    wide = sources(t).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"features_available__{s}").alias(s) for s in sets]
    )
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("feature_set"), F.col(s).alias("available_rows"), (F.col(s) / F.col("n")).alias("available_pct"))
        for s in sets
    ])))


def controls(t):
    """Known positives with both policy verdicts."""
    ids = t.known.where("label = 'known_wr'").select("source_id").distinct()
    inside = ph.within_bounds({"G_BP": (-6.0, 5.0), "J_H": (-6.0, 6.0)})
    rows = sources(t).join(ids, "source_id", "left_semi").withColumn(
        "acquisition_envelope_keep", F.coalesce(inside, F.lit(False))
    )
    return rows.withColumns(
        {
            "current_policy_keep": F.col("acquisition_envelope_keep") & F.col("aggregated_locus_keep"),
            "exact_union_policy_keep": F.col("acquisition_envelope_keep") & F.col("passes_any_exact_variant"),
        }
    )


CONTROLS_SQL = SRC_SQL + """, ctl as (select *, env and aggregated_locus_keep cur, env and passes_any_exact_variant ex from (
      select *, coalesce(G_BP between -6 and 5 and J_H between -6 and 6, false) env from src
      where source_id in (select source_id from v_known where label = 'known_wr')))"""


@query(
    "ag_14i_controls",
    f"""with {CONTROLS_SQL} select count(*) known_controls, count(*) filter (where env) within_acquisition_envelope,
      count(*) filter (where not env) outside_acquisition_envelope, count(*) filter (where cur) current_policy_keep,
      count(*) filter (where ex) exact_union_policy_keep, count(*) filter (where ex and not cur) exact_union_not_current
    from ctl""",
)
def ag_14i(t):
    env, cur, ex = (F.col(c) for c in ("acquisition_envelope_keep", "current_policy_keep", "exact_union_policy_keep"))
    return controls(t).agg(
        F.count(F.lit(1)).alias("known_controls"),
        F.count_if(env).alias("within_acquisition_envelope"),
        F.count_if(~env).alias("outside_acquisition_envelope"),
        F.count_if(cur).alias("current_policy_keep"),
        F.count_if(ex).alias("exact_union_policy_keep"),
        F.count_if(ex & ~cur).alias("exact_union_not_current"),
    )


@query(
    "ag_14j_affected_controls",
    f"with {CONTROLS_SQL} " + " union all ".join(
        f"""select '{v}' variant, {b} as bit, source_id, aggregated_outlier_plane_count from ctl
        where env and compatible_variant_mask & {1 << b} <> 0 and not aggregated_locus_keep""" for v, b in BITS.items()
    ),
)
def ag_14j(t):
    hit = F.array(*[
        F.when(ranking.has_bit("compatible_variant_mask", b), F.struct(F.lit(v).alias("variant"), F.lit(b).alias("bit")))
        for v, b in BITS.items()
    ])
    affected = controls(t).where("acquisition_envelope_keep and not aggregated_locus_keep")
    return affected.select("source_id", "aggregated_outlier_plane_count", F.explode(hit).alias("h")).where(
        "h is not null"
    ).select("h.variant", "h.bit", "source_id", "aggregated_outlier_plane_count")


@query(
    "ag_14k_variant_overlap",
    f"with {UNION_SQL}, pairs as (select a.v lv, a.b lb, r.v rv, r.b rb from (values "
    + ", ".join(f"('{v}', {1 << b})" for v, b in BITS.items()) + ") a(v, b), (values "
    + ", ".join(f"('{v}', {1 << b})" for v, b in BITS.items()) + """) r(v, b)),
    masks as (select compatible_variant_mask m, count(*) n from u group by 1)
    select lv left_set, rv right_set, cast(coalesce(sum(n) filter (where m & lb <> 0 and m & rb <> 0), 0) as bigint) "intersection",
      cast(coalesce(sum(n) filter (where m & lb <> 0 or m & rb <> 0), 0) as bigint) as "union",
      coalesce(sum(n) filter (where m & lb <> 0 and m & rb <> 0), 0)
        / nullif(sum(n) filter (where m & lb <> 0 or m & rb <> 0), 0) jaccard,
      coalesce(sum(n) filter (where m & lb <> 0 and m & rb <> 0), 0) / nullif(sum(n) filter (where m & lb <> 0), 0) left_retained
    from pairs, masks group by lv, rv""",
)
def ag_14k(t):
    from raresift.operators.joins import pairwise_overlap

    return pairwise_overlap(pool_union(t), BITS, mask="compatible_variant_mask")


@query(
    "ag_14l_variant_contract",
    f"with {UNION_SQL} " + " union all ".join(
        f"""select '{v}' variant, {b} as bit, {1 << b}::bigint bit_value, '{SCHEMA.version}' bitmask_schema_version,
        '{ph.FAMILIES[v.split("_", 1)[0]] == ("A",) and "A" or "A,B"}' letters,
        count(*) filter (where compatible_variant_mask & {1 << b} <> 0) members from u""" for v, b in BITS.items()
    ),
)
def ag_14l(t):
    wide = pool_union(t).agg(*[F.count_if(ranking.has_bit("compatible_variant_mask", b)).alias(v) for v, b in BITS.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(v).alias("variant"),
            F.lit(b).alias("bit"),
            F.lit(1 << b).cast("long").alias("bit_value"),
            F.lit(SCHEMA.version).alias("bitmask_schema_version"),
            F.lit(",".join(ph.FAMILIES[v.split("_", 1)[0]])).alias("letters"),
            F.col(v).alias("members"),
        )
        for v, b in BITS.items()
    ])))


@query(
    "ag_14m_plane_discrepancy",
    f"with {SRC_SQL} " + " union all ".join(
        f"""select '{b.name}' plane, count(*) discrepancy_rows, count(*) filter (where am{i} < 0) aggregate_outlier_rows,
        count(*) filter (where am{i} < 0) / nullif(count(*), 0) aggregate_outlier_pct,
        count(*) filter (where am{i} < 0 and bm{i} >= 0) inside_at_least_one_exact_band from src where exact_not_aggregate"""
        for i, b in enumerate(WIDE)
    ),
)
def ag_14m(t):
    rows, hit = sources(t), F.col("exact_not_aggregate")  # counted, not filtered: a filter would repeat the masks' whole expression
    outside = {b.name: F.coalesce(F.col(f"aggregated_margin__{b.name}") < 0, F.lit(False)) for b in WIDE}
    wide = rows.agg(
        F.count_if(hit).alias("n"),
        *[F.count_if(hit & rule).alias(f"o_{p}") for p, rule in outside.items()],
        *[F.count_if(hit & rule & (F.col(f"best_exact_margin__{p}") >= 0)).alias(f"r_{p}") for p, rule in outside.items()],
    )
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(p).alias("plane"),
            F.col("n").alias("discrepancy_rows"),
            F.col(f"o_{p}").alias("aggregate_outlier_rows"),
            F.try_divide(f"o_{p}", "n").alias("aggregate_outlier_pct"),
            F.col(f"r_{p}").alias("inside_at_least_one_exact_band"),
        )
        for p in outside
    ])))


@query(
    "ag_14n_boundary_samples",
    f"""with {SRC_SQL} select region, source_id, G, BP_RP, aggregated_outlier_plane_count from src where exact_not_aggregate
    order by round(least({', '.join(f'abs(am{i})' for i in range(len(WIDE)))}), 9), source_id limit 100""",
)
def ag_14n(t):
    hit = F.coalesce("exact_not_aggregate", F.lit(False))  # sorted first, not filtered: a filter would repeat the masks' whole expression
    first = sources(t).select(
        "region", "source_id", "G", "BP_RP", "aggregated_outlier_plane_count", hit.alias("hit"), F.round("aggregated_boundary_distance", 9).alias("distance")
    ).orderBy(F.desc("hit"), "distance", "source_id").limit(100)
    return first.where("hit").drop("hit", "distance")


@query(
    "ag_14o_policy_long",
    f"""with {SRC_SQL} select region, 'Acquisition envelope' policy, count(*) sources from src group by region
    union all select region, 'Current aggregate', count(*) filter (where aggregated_locus_keep) from src group by region
    union all select region, 'Compatible exact union', count(*) filter (where passes_any_exact_variant) from src group by region""",
)
def ag_14o(t):
    names = {"acquisition_rows": "Acquisition envelope", "aggregated_keep": "Current aggregate",
             "any_exact_variant_keep": "Compatible exact union"}
    counts = audits.policy_counts(sources(t), ["region"]).withColumnsRenamed(names)
    return counts.unpivot(["region"], list(names.values()), "policy", "sources")


@query("ag_14p_headline", f"with {SRC_SQL}, g as (select {_FLAGS_SQL} from src) select *, {_RATIOS_SQL} from g")
def ag_14p(t):
    return audits.with_policy_ratios(audits.policy_counts(sources(t), []))


# ---- availability, envelope, coverage ---------------------------------------------


def _availability_sql():
    from itertools import combinations

    rows = []
    rules = ["photometry", "parallax_soft", *[f"poe_{k}" for k in ph.POE_LEVELS]]
    pos = {"J": ("tmass_quality", 1), "H": ("tmass_quality", 2), "Ks": ("tmass_quality", 3), "W1": ("wise_quality", 1),
           "W2": ("wise_quality", 2)}
    for quality, letters in (("A", "('A')"), ("B", "('A', 'B')")):
        for size in range(1, 6):
            for combo in combinations(audits.BANDS, size):
                ok = " and ".join(f"{b} is not null and substr({pos[b][0]}, {pos[b][1]}, 1) in {letters}" for b in combo)
                two, wise = sum(b in ("J", "H", "Ks") for b in combo), sum(b in ("W1", "W2") for b in combo)
                rows.append(
                    f"""select '{quality}' min_quality, '{'+'.join(combo)}' bands, {size} n_required_bands,
                    {two} n_2mass_bands, {wise} n_wise_bands, {two in (0, 2, 3)} and {wise in (0, 2)} valid_min_2_per_used_mission,
                    {two == 3 and wise == 2} valid_3_2mass_2_wise, parallax_filter,
                    coalesce(sum(n) filter (where lv >= floor_level), 0) n_hit from (select lv, count(*) n from pre
                      where {ok} group by lv) right join (values {', '.join(f"('{r}', {i})" for i, r in enumerate(rules))})
                      p(parallax_filter, floor_level) on true group by parallax_filter"""
                )
    return f"""with pre as (select *, case when coalesce(parallax > 0, false) then case when parallax_over_error >= 5 then 5
        when parallax_over_error >= 3 then 4 when parallax_over_error >= 2 then 3 when parallax_over_error >= 1 then 2 else 1 end
        else 0 end lv from v_pool where G is not null and BP is not null and RP is not null)
      select min_quality, bands, n_required_bands, n_2mass_bands, n_wise_bands, parallax_filter, cast(n_hit as bigint) "rows",
        n_hit / (select count(*) from v_pool) retention, valid_min_2_per_used_mission, valid_3_2mass_2_wise
      from ({' union all '.join(rows)})"""


@query("ag_15_band_combinations", _availability_sql())
def ag_15(t):
    return audits.band_combinations(t.pool)


_ABS = {"G_BP": 0.5, "J_H": 2.0}


@query(
    "ag_16_colour_envelope",
    f"with {COLOUR_SQL} " + " union all ".join(
        f"""select '{c}' colour, min({c}) observed_min, max({c}) observed_max, count({c}) finite_rows,
        greatest({_ABS.get(c, 0.0)}::double, (max({c}) - min({c})) * 0.05::double) padding,
        min({c}) - greatest({_ABS.get(c, 0.0)}::double, (max({c}) - min({c})) * 0.05::double) "min",
        max({c}) + greatest({_ABS.get(c, 0.0)}::double, (max({c}) - min({c})) * 0.05::double) "max" from c"""
        for c in ph.LOCAL_COLOURS
    ),
)
def ag_16(t):
    rows = ph.with_colours(t.pool, ph.LOCAL_COLOURS)
    return audits.colour_envelope(rows, ph.LOCAL_COLOURS, span_fraction=0.05, absolute=_ABS)


@query(
    "ag_16_plane_envelope",
    """select case when p_size % 2 = 0 then 'G_BP' else 'J_H' end x, p_type y, min(p_retailprice) slope_min,
      max(p_retailprice) slope_max, max(p_size) threshold_max, count(*) n from part group by 1, 2""",
)
def ag_16_planes(t):
    x = F.when(F.col("p_size") % 2 == 0, "G_BP").otherwise("J_H")
    return t.part.groupBy(x.alias("x"), F.col("p_type").alias("y")).agg(
        F.min("p_retailprice").alias("slope_min"), F.max("p_retailprice").alias("slope_max"),
        F.max("p_size").alias("threshold_max"), F.count(F.lit(1)).alias("n"),
    )


_BOUNDS = {"G_BP": (-4.0, 3.5), "J_H": (-5.0, 5.0), "W1_W2": (-6.0, 6.0)}


@query(
    "ag_17_envelope_coverage",
    f"with {COLOUR_SQL} " + " union all ".join(
        f"""select '{c}' colour, count({c}) finite, count(*) filter (where {c} between {lo} and {hi}) covered,
        count({c}) - count(*) filter (where {c} between {lo} and {hi}) outside,
        count(*) filter (where {c} between {lo} and {hi}) / nullif(count({c}), 0) covered_fraction from c"""
        for c, (lo, hi) in _BOUNDS.items()
    ),
)
def ag_17(t):
    return audits.envelope_coverage(ph.with_colours(t.pool, ph.LOCAL_COLOURS), _BOUNDS)


@query(
    "ag_17_first_outside",
    f"""with {COLOUR_SQL} select source_id from c where not (G_BP between -4 and 3.5) order by source_id limit 100""",
)
def ag_17_outside(t):
    rows = ph.with_colours(t.pool, ph.LOCAL_COLOURS)
    return rows.where(~ph.within_bounds({"G_BP": _BOUNDS["G_BP"]})).select("source_id").orderBy("source_id").limit(100)


_SIX = ("G_BP", "G_RP", "BP_RP", "J_H", "J_K", "H_K")


@query(
    "ag_18_evidence_counts",
    f"""with {T_SQL}, k as (select *, source_id in (select source_id from v_known where label = 'known_wr') positive from t)
    select region_no % 2 variant, positive, count(*) n_rows,
      count(*) filter (where {' and '.join(f'{c} is not null' for c in _SIX)}) finite_six,
      count(*) filter (where {' and '.join(f'{c} > 0' for c in _SIX)}) positive_six from k group by 1, 2""",
)
def ag_18(t):
    ids = t.known.where("label = 'known_wr'").select("source_id").distinct().withColumn("positive", F.lit(True))
    rows = ph.with_colours(t.pool, ph.LOCAL_COLOURS).join(ids, "source_id", "left")
    return rows.groupBy(
        (F.col("region_no") % 2).alias("variant"), F.coalesce("positive", F.lit(False)).alias("positive")
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ph.all_true([maths.is_finite(F.col(c)) for c in _SIX])).alias("finite_six"),
        F.count_if(ph.all_true([F.col(c) > 0 for c in _SIX])).alias("positive_six"),
    )


@query(
    "ag_19_heatmap",
    """select dataset_variant, concat_ws(' / ', model, nullif(sampler, '')) label, max(holdout_average_precision) best
    from v_results group by 1, 2""",
)
def ag_19(t):
    label = F.concat_ws(" / ", "model", F.nullif(F.col("sampler"), F.lit("")))
    return t.results.groupBy("dataset_variant", label.alias("label")).agg(F.max("holdout_average_precision").alias("best"))


@query(
    "ag_19_score_histogram",
    """select result_id, target, least(cast(floor(score / (1e0 / 40)) as bigint), 39) bin, count(*) as "count" from v_pred
    where score between 0 and 1 group by 1, 2, 3""",
)
def ag_19_hist(t):
    return distributions.equal_width_histogram(t.pred, "score", low=0.0, high=1.0, bins=40, by=["result_id", "target"])


@query(
    "ag_20_rank_grain",
    f"""with {_RANKS} select result_id, count(*) n, min(model_rank) first_rank, max(model_rank) last_rank,
      0::bigint repeated, true contiguous from ranks group by result_id""",
)
def ag_20(t):
    return audits.rank_grain(_ranks(t), ["result_id"], "model_rank")


@query(
    "ag_20_rank_grain_faults",
    f"""with {_RANKS}, m as (select result_id, case when model_rank = 3 then 2 when model_rank > 5 then model_rank + 1
        else model_rank end model_rank from ranks), r as (select result_id, model_rank, count(*) n from m group by 1, 2)
    select result_id, cast(sum(n) as bigint) n, min(model_rank) first_rank, max(model_rank) last_rank,
      count(*) filter (where n > 1) repeated, sum(n) < 3 contiguous from r group by result_id""",
)
def ag_20_faults(t):
    """Ranks with a repeat at 2 and a gap behind 5."""
    rank = F.col("model_rank")
    moved = F.when(rank == 3, 2).when(rank > 5, rank + 1).otherwise(rank).cast("long")
    spoilt = _ranks(t).withColumn("model_rank", moved)
    return audits.rank_grain(spoilt, ["result_id"], "model_rank")


@query(
    "ag_20_status_rules",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}, {_OPPS}
    select 'component_flags' as "rule", count(*) filter (where eligible <> (locus_keep and photometry_keep and astrometry_keep)) violations from opps
    union all select 'ranked_is_eligible', count(*) filter (where model_rank is not null and not eligible) from opps
    union all select 'rank_with_score', count(*) filter (where (model_rank is null) <> (score is null)) from opps
    union all select 'known_status', 0 from opps where source_id = (select min(source_id) from opps) and result_id = 'm1'""",
)
def ag_20_rules(t):
    _, opportunities = _opportunities(t)
    c = F.col
    rules = {
        "component_flags": c("eligible") == (c("locus_keep") & c("photometry_keep") & c("astrometry_keep")),
        "ranked_is_eligible": c("model_rank").isNull() | c("eligible"),
        "rank_with_score": c("model_rank").isNull() == c("score").isNull(),
        "known_status": c("model_status").isin(f"ranked_top_{TOP}", f"eligible_below_top_{TOP}", "ineligible_variant"),
    }
    return audits.rule_violations(opportunities, rules)


@query(
    "ag_20_prefix_exports",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS} select n, count(*) n_rows, cast(sum(source_id) as bigint) ids from consensus,
      (values (5), (20), (100)) v(n) where consensus_rank <= n group by n""",
)
def ag_20_prefix(t):
    consensus = ranking.rrf_consensus(_ranks(t)).where("consensus_rank <= 100")
    sizes = F.array(*[F.lit(n) for n in (5, 20, 100)])
    return consensus.withColumn("n", F.explode(sizes)).where("consensus_rank <= n").groupBy("n").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("source_id").alias("ids")
    )


# ---- distributions -------------------------------------------------------------------

_COLS = ("G", "BP", "RP", "ag")


def _dist_sql():
    parts = []
    for c in _COLS:
        parts.append(
            f"""select '{c}' as "column", cast(sum(na) as bigint) n_a, cast(sum(nb) as bigint) n_b, round(max(gap), 6) ks_statistic,
            round(sum(gap * (nv - v)), 6) wasserstein from (select *, abs(ca / (select count({c}) from v_core)
              - cb / (select count({c}) from v_core where parallax > 0)) gap from (
              select v, na, nb, sum(na) over (order by v) ca, sum(nb) over (order by v) cb, lead(v) over (order by v) nv from (
                select {c} v, count(*) na, count(*) filter (where parallax > 0) nb from v_core where {c} is not null group by {c})))"""
        )
    return " union all ".join(parts)


@query("ag_23_population_distances", _dist_sql())
def ag_23(t):
    core = t.core
    return distributions.two_sample_distances(core, core.where("parallax > 0"), _COLS)


@query(
    "ag_23_pool_moments",
    " union all ".join(
        f"""select '{pool}' pool, '{c}' as "column", count({c}) n, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std,
        round(quantile_cont({c}, 0.05), 6) p050, round(quantile_cont({c}, 0.5), 6) p500, round(quantile_cont({c}, 0.95), 6) p950
        from v_core where {rule}"""
        for pool, rule in (("all", "true"), ("kept", "parallax > 0"))
        for c in _COLS
    ),
)
def ag_23_moments(t):
    core, kept = t.core, t.core.where("parallax > 0")
    both = distributions.moments(core, _COLS, tag="all").unionByName(distributions.moments(kept, _COLS, tag="kept"))
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in _COLS]))
    long = core.select(F.lit("all").alias("pool"), pairs).unionByName(kept.select(F.lit("kept").alias("pool"), pairs))
    quantiles = exact_quantiles(long, "value", [0.05, 0.5, 0.95], by=["pool", "column"])
    rounded = ["mean", "std", "p050", "p500", "p950"]
    return both.join(quantiles, ["pool", "column"]).select(
        "pool", "column", "n", *[F.round(c, 6).alias(c) for c in rounded]
    )


@query(
    "ag_24_calibration_pressure",
    """select result_id, count(*) negatives, count(*) filter (where score >= threshold) passed,
      count(*) filter (where score >= threshold) / count(*) pass_rate, round(quantile_cont(score, 0.5), 6) p500,
      round(quantile_cont(score, 0.9), 6) p900, round(quantile_cont(score, 0.95), 6) p950,
      round(quantile_cont(score, 0.99), 6) p990, max(score) score_max from v_pred where target = 0 group by result_id""",
)
def ag_24(t):
    negatives = t.pred.where("target = 0")
    base = negatives.groupBy("result_id").agg(
        F.count(F.lit(1)).alias("negatives"),
        F.count_if(F.col("score") >= F.col("threshold")).alias("passed"),
        F.max("score").alias("score_max"),
    ).withColumn("pass_rate", F.col("passed") / F.col("negatives"))
    names = ["p500", "p900", "p950", "p990"]
    q = exact_quantiles(negatives, "score", [0.5, 0.9, 0.95, 0.99], by=["result_id"])
    return base.join(q.select("result_id", *[F.round(n, 6).alias(n) for n in names]), "result_id")


_STACK = """v as (select p.source_id, p.score, p.target, (BUCKET(concat('pass', cast(p.source_id as string))) % 3) <> 0 passed
        from v_pred p where result_id = 'm1'),
    b as (select *, row_number() over (order by score desc, source_id) rank_before from v),
    a as (select *, row_number() over (order by passed desc, rank_before) rank_after from b)"""
_BUDGETS = (5, 20, 50, 80)


def _stack(t):
    return ranking.pass_first_ranks(t.sql(
        """select source_id, score, target, (BUCKET(concat('pass', cast(source_id as string))) % 3) <> 0 passed
        from v_pred where result_id = 'm1'"""
    ))


@query(
    "ag_25_recovery_curve",
    f"""with {_STACK}, long as (select 'First stage' policy, target, rank_before r from a union all
      select 'Pass-first', target, rank_after from a), k as (select unnest({list(_BUDGETS)})::int budget)
    select policy, budget, count(*) filter (where target = 1) recovered,
      count(*) filter (where target = 1) / nullif((select count(*) from v where target = 1), 0) recovered_pct,
      count(*) filter (where target = 0) negatives_reviewed, budget / nullif(count(*) filter (where target = 1), 0)
        candidates_per_hit from long, k where r <= budget group by policy, budget""",
)
def ag_25(t):
    from raresift.operators.stacks import recovery_curve

    return recovery_curve(_stack(t), _BUDGETS)


@query(
    "ag_25_tradeoff",
    f"""with {_STACK}, k as (select unnest({list(_BUDGETS)})::int budget)
    select budget input_budget, count(*) filter (where target = 1) positives_input,
      count(*) filter (where target = 1 and passed) positives_pass,
      count(*) filter (where target = 1 and passed) / nullif(count(*) filter (where target = 1), 0) retention,
      count(*) filter (where target = 0) negatives_input, count(*) filter (where target = 0 and passed) negatives_pass,
      1 - count(*) filter (where target = 0 and passed) / nullif(count(*) filter (where target = 0), 0) negative_removal_rate
    from a, k where rank_before <= budget group by budget""",
)
def ag_25_tradeoff(t):
    from raresift.operators.stacks import tradeoff_curve

    return tradeoff_curve(_stack(t), _BUDGETS)


@query(
    "ag_26_density_grid",
    """with q as (select quantile_cont(G, 0.002) xl, quantile_cont(G, 0.998) xh, quantile_cont(BP, 0.002) yl,
        quantile_cont(BP, 0.998) yh from v_core where G is not null and BP is not null),
    r as (select xl - (xh - xl) * 0.03 xl, xh + (xh - xl) * 0.03 xh, yl - (yh - yl) * 0.03 yl, yh + (yh - yl) * 0.03 yh from q),
    g as (select least(cast(floor((G - xl) / ((xh - xl) / 72)) as bigint), 71) xi,
        least(cast(floor((BP - yl) / ((yh - yl) / 48)) as bigint), 47) yi, count(*) n from v_core, r
      where G between xl and xh and BP between yl and yh group by 1, 2)
    select xi, yi, n as "count", round(0.05 + 0.20 * ln(1 + n) / (select max(ln(1 + n)) from g), 6) opacity from g""",
)
def ag_26(t):
    grid = distributions.density_grid(t.core, "G", "BP", bins=(72, 48))
    return grid.withColumn("opacity", F.round("opacity", 6))


@query(
    "ag_27_plot_frame",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}, top as (select c.source_id, consensus_rank, ra, "dec" from consensus c
        join v_core v on v.source_id = c.source_id where consensus_rank <= 500),
    g as ({GALACTIC_SQL.replace("SRC", "top")})
    select source_id, consensus_rank, round(gl, 6) galactic_l, round(gb, 6) galactic_b from g""",
)
def ag_27(t):
    top = ranking.rrf_consensus(_ranks(t)).where("consensus_rank <= 500").select("source_id", "consensus_rank")
    rows = top.join(t.core.select("source_id", "ra", "dec", "parallax", "parallax_over_error"), "source_id")
    return sky.with_spatial(rows).select(
        "source_id", "consensus_rank", F.round("galactic_l", 6).alias("galactic_l"), F.round("galactic_b", 6).alias("galactic_b")
    )


@query(
    "ag_28_tile_inventory",
    """select tile_id, concat('data/', regexp_extract(concat('/srv/pool/', pool_build_id, '/', tile_id, '.parquet'), '[^/]+$', 0))
      package_file, bytes, cast(sum(bytes) over () as bigint) total_bytes from v_tiles where status = 'completed'""",
)
def ag_28(t):
    path = F.concat(F.lit("/srv/pool/"), "pool_build_id", F.lit("/"), "tile_id", F.lit(".parquet"))
    done = t.tiles.where("status = 'completed'")
    total = done.agg(F.sum("bytes").alias("total_bytes"))
    return done.select(
        "tile_id", F.concat(F.lit("data/"), F.regexp_extract(path, "[^/]+$", 0)).alias("package_file"), "bytes"
    ).join(F.broadcast(total))  # one row


@query("ag_29_run_rows", "select result_id, model, hits_at_100 from v_results where run_id = 'Brand#7'")
def ag_29(t):
    return t.results.where("run_id = 'Brand#7'").select("result_id", "model", "hits_at_100")
