"""Join, cross-match and de-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.functions import hashing, photometry as ph, text
from raresift.operators import counterparts, dedup, joins, ranking, zone_join
from raresift.operators.ordered import global_rank
from raresift.plans.rank_queries import _CONSENSUS, _FUSED, _OPPS, _RANKS, MODELS, TOP, _opportunities, _ranks
from raresift.plans.registry import query

_COLOURS_SQL = ", ".join(f"{l} - {r} {n}" for n, (l, r) in ph.COLOURS.items())


@query(
    "jn_01_feature_frame",
    f"""select k.source_id, ra, "dec", G, BP, RP, parallax, J, H, Ks, tmass_quality, W1, W2, wise_quality,
      {_COLOURS_SQL}, 'wr' sample_label
    from (select distinct source_id from v_known where label = 'known_wr') k
      join v_core c on c.source_id = k.source_id left join v_ir_best i on i.source_id = k.source_id
      left join v_wise w on w.source_id = k.source_id""",
)
def jn_01(t):
    labels = t.known.where("label = 'known_wr'").select("source_id").distinct()
    frame = joins.feature_frame(labels, t.core, t.ir_best, t.wise, "wr")
    return frame.select(
        "source_id", "ra", "dec", "G", "BP", "RP", "parallax", "J", "H", "Ks", "tmass_quality", "W1", "W2",
        "wise_quality", *ph.COLOURS, "sample_label",
    )


_BRIDGE = """select o_orderkey * 10 + ln source_id, o_custkey, o_totalprice from orders
    lateral view explode(sequence(1, 7)) s as ln"""


_ACQUISITION = """select source_id, ra, "dec", G_BP, J_H, W1_W2, c_mktsegment, n_name from (
      select c.source_id, c.ra, c."dec", c.G - c.BP G_BP, i.J - i.H J_H, w.W1 - w.W2 W1_W2, cu.c_mktsegment, n.n_name
      from v_core c join orders o on o.o_orderkey = c.source_id // 10 join customer cu on cu.c_custkey = o.o_custkey
        join v_ir_best i on i.source_id = c.source_id join v_wise w on w.source_id = c.source_id
        left join nation n on n.n_nationkey = cu.c_nationkey and n.n_regionkey < 3
      where c.ra >= 20 and c.ra < 300 and c."dec" >= -60 and c."dec" < 60 and c.RP is not null)
    where G_BP between -5::double and 5::double and J_H between -6::double and 6::double"""


def _acquired(t, limit):
    nation = t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name")
    bridge = (
        t.orders.select("o_orderkey", "o_custkey")
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("o_orderkey"), "c_mktsegment", "n_name")
    )
    # The bridge is keyed by the parent of a source, so the source side derives that key.
    core = t.core.withColumn("o_orderkey", F.floor(F.col("source_id") / 10)).join(bridge, "o_orderkey")
    got = joins.acquire(
        core,
        [t.ir_best, t.wise],
        None,
        box={"ra": (20.0, 300.0), "dec": (-60.0, 60.0)},
        not_null=["RP"],
        bounds={"G_BP": (-5.0, 5.0), "J_H": (-6.0, 6.0)},
        limit=limit,
    )
    return got.select("source_id", "ra", "dec", "G_BP", "J_H", "W1_W2", "c_mktsegment", "n_name")


@query("jn_02_acquisition", f"{_ACQUISITION} order by source_id limit 5000")
def jn_02(t):
    return _acquired(t, 5000)


@query("jn_02_acquisition_all", _ACQUISITION)
def jn_02_all(t):
    return _acquired(t, None)


_SEP = """2 * degrees(asin(sqrt(least(1e0, pow(sin(radians(b."dec" - a."dec") / 2), 2) + cos(radians(a."dec"))
    * cos(radians(b."dec")) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) * 3600"""
_CONE = f"""select a.source_id, a.ra, a."dec", b.cat_id, b.main_id, b.listed_id, {_SEP} sep_arcsec from v_sky a, v_sky2 b
    where abs(a."dec" - b."dec") < 0.01 and {_SEP} <= """


@query("jn_03_cone_match", f"select source_id, cat_id, round(sep_arcsec, 6) sep_arcsec from ({_CONE} 4)")
def jn_03(t):
    pairs = zone_join.cone_match(t.sky, t.sky2, radius_arcsec=4.0)
    return pairs.select("source_id", "cat_id", F.round("sep_arcsec", 6).alias("sep_arcsec"))


@query(
    "jn_04_two_step_match",
    f"""with ex as (select listed_id source_id, min_by(main_id, cat_id) main_id from v_sky2
        where listed_id in (select source_id from v_sky) group by listed_id),
    near as (select source_id, count(*) match_count, min(sep_arcsec) separation_arcsec,
        arg_min(main_id, (sep_arcsec, cat_id)) main_id from ({_CONE} 2)
      where source_id not in (select source_id from ex) group by source_id)
    select s.source_id, ex.source_id is not null or near.source_id is not null match_found,
      case when ex.source_id is not null then 'exact_id' when near.match_count = 1 then 'position_unique'
        when near.match_count > 1 then 'position_ambiguous' else 'none' end match_method,
      case when ex.source_id is not null then 1 else coalesce(near.match_count, 0) end match_count,
      round(case when ex.source_id is not null then 0 else near.separation_arcsec end, 6) separation_arcsec,
      coalesce(ex.main_id, near.main_id) main_id
    from v_sky s left join ex on ex.source_id = s.source_id left join near on near.source_id = s.source_id""",
)
def jn_04(t):
    matched = zone_join.two_step_match(t.sky, t.sky2, radius_arcsec=2.0)
    return matched.withColumn("separation_arcsec", F.round("separation_arcsec", 6))


@query(
    "jn_05_fill_matches",
    f"""with have as (select listed_id source_id, min(cat_id) cat_id from v_sky2 where listed_id is not null
        group by listed_id),
    miss as (select *, count(*) over (partition by source_id) n, count(*) filter (where sep_arcsec <= 3)
        over (partition by source_id) n1, count(*) filter (where sep_arcsec <= 1) over (partition by source_id) n2
      from ({_CONE} 4) where source_id not in (select source_id from have))
    select source_id, cat_id, 'listed' match_method from have union all
    select source_id, cat_id, 'cone' from miss where n = 1 or (n1 = 1 and sep_arcsec <= 3)
      or (n1 > 1 and n2 = 1 and sep_arcsec <= 1)""",
)
def jn_05(t):
    have = (
        t.sky2.where(F.col("listed_id").isNotNull())
        .groupBy(F.col("listed_id").alias("source_id"))
        .agg(F.min("cat_id").alias("cat_id"))
    )
    rest = t.sky.join(have, "source_id", "left_anti")
    pairs = zone_join.cone_match(rest, t.sky2, radius_arcsec=4.0).select("source_id", "cat_id", "sep_arcsec")
    kept = dedup.radius_kept(dedup.resolve_by_radius(pairs, primary=3.0, secondary=1.0))
    return have.withColumn("match_method", F.lit("listed")).unionByName(
        kept.select("source_id", "cat_id", F.lit("cone").alias("match_method"))
    )


@query(
    "jn_06_exclude_known",
    """with l as (select source_id, arg_max(label, prio) label from v_known group by source_id)
    select coalesce(l.label, 'written') outcome, count(*) n, cast(sum(c.source_id) as bigint) ids
    from v_core c left join l using (source_id) group by 1""",
)
def jn_06(t):
    hits, survivors = joins.exclude_known(
        t.core.select("source_id"), joins.label_map(t.known, last_wins=True)
    )
    both = hits.select("source_id", F.col("label").alias("outcome")).unionByName(
        survivors.withColumn("outcome", F.lit("written"))
    )
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("source_id").alias("ids"))


@query(
    "jn_07_known_label",
    """select c.source_id, l.label known_source_exclusion from v_core c left join
      (select source_id, arg_min(label, prio) label from v_known group by source_id) l on l.source_id = c.source_id""",
)
def jn_07(t):
    labels = joins.label_map(t.known).withColumnRenamed("label", "known_source_exclusion")
    return t.core.select("source_id").join(labels, "source_id", "left")


@query(
    "jn_08_case_rows",
    """select row_number() over (order by score desc, p.source_id) rank, p.source_id, target, score,
      G - BP G_BP, G - RP G_RP, BP - RP BP_RP, case when target = 1 then
        case when spectral_type is null then 'unknown' when upper(spectral_type) like '%WN%' and
          upper(spectral_type) like '%WC%' then 'WN/WC' when upper(spectral_type) like '%WN%' then 'WN'
          when upper(spectral_type) like '%WC%' then 'WC' when upper(spectral_type) like '%WO%' then 'WO'
          else 'other' end end subtype,
      case when target = 1 and wr_number is not null then concat('WR ', wr_number)
        when main_id is not null then main_id else concat('Gaia DR3 ', cast(p.source_id as string)) end object_name
    from v_pred p
      left join (select source_id, min(cast(n_chars as string)) wr_number, min(spectral_type) spectral_type from v_ident
        where spectral_type is not null group by source_id) a on a.source_id = p.source_id
      left join (select source_id, min(main_id) main_id from v_ident where other_types <> 'en' group by source_id) b
        on b.source_id = p.source_id
      left join (select source_id, G, BP, RP from v_core) c on c.source_id = p.source_id
    where result_id = 'm1'""",
)
def jn_08(t):
    ident = t.ident
    positives = ident.where("spectral_type is not null").select(
        "source_id", F.col("n_chars").cast("string").alias("wr_number"), "spectral_type"
    )
    negatives = ident.where("other_types <> 'en'").select("source_id", "main_id", "main_type")
    rows = joins.case_rows(
        t.pred.where("result_id = 'm1'"), positives, negatives, t.core.select("source_id", "G", "BP", "RP")
    )
    ranked = global_rank(rows, order=[F.desc("score"), F.asc("source_id")], name="rank")
    return ranked.select(
        "rank", "source_id", "target", "score", "G_BP", "G_RP", "BP_RP", "subtype", "object_name"
    )


@query(
    "jn_10_grain_check",
    f"""with {_RANKS}, {_FUSED}, r as (select c.source_id from fused f join v_core c using (source_id))
    select (select count(*) from r) "rows", (select count(distinct source_id) from r) keys,
      (select count(*) from fused) ids, (select count(distinct source_id) from fused) distinct_ids,
      (select count(*) from r) = (select count(*) from fused) grain_kept""",
)
def jn_10(t):
    ids = ranking.rrf_scores(_ranks(t)).select("source_id")
    return joins.grain_check(t.core.join(ids, "source_id", "inner"), ids)


_SCORED = """select s.result_id, s.source_id, s.variant_bit,
    md5(case when s.source_id % 50 = 0 then 'old' else cast(s.source_id as string) end) scored_hash from v_scores s"""
_SOURCES = """select e.source_id, e.compatible_mask, md5(cast(e.source_id as string)) source_hash, k.label known
    from v_elig e left join (select source_id, min(label) label from v_known group by source_id) k
      on k.source_id = e.source_id where e.locus_mask <> 0"""


@query(
    "jn_11_score_audit",
    f"""select result_id, source_id, concat_ws('|', case when compatible_mask is null then 'source_missing' end,
      case when source_hash <> scored_hash then 'hash_changed' end, case when known is not null then 'known_source' end,
      case when compatible_mask = 0 then 'not_eligible' end,
      case when compatible_mask & (1::bigint << variant_bit) = 0 then 'bit_off' end) reasons
    from ({_SCORED}) a left join ({_SOURCES}) b using (source_id) where compatible_mask is null
      or source_hash <> scored_hash or known is not null or compatible_mask = 0
      or compatible_mask & (1::bigint << variant_bit) = 0""",
)
def jn_11(t):
    return joins.bad_scores(t.sql(_SCORED), t.sql(_SOURCES))


_WIDE = ["model_status", "eligibility_reason", "model_rank", "score"]


@query(
    "jn_12_wide_export",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}, {_OPPS}, st as (select *, case when model_rank is not null
        then 'ranked_top_{TOP}' when eligible then 'eligible_below_top_{TOP}' else 'ineligible_variant' end s from opps)
    select c.source_id, c.consensus_rank, """
    + ", ".join(
        f"""max(case when result_id = '{m}' then s end) {m}_status, max(case when result_id = '{m}' then model_rank end)
        {m}_rank, max(case when result_id = '{m}' then score end) {m}_score"""
        for m in ("m1", "m2", "m3")
    )
    + " from consensus c join st on st.source_id = c.source_id group by c.source_id, c.consensus_rank",
)
def jn_12(t):
    consensus, opportunities = _opportunities(t)
    wide = joins.widen_models(
        opportunities, [m["result_id"] for m in MODELS], ["model_status", "model_rank", "score"]
    )
    names = {f"{m}_model_{c}": f"{m}_{c}" for m in ("m1", "m2", "m3") for c in ("status", "rank")}
    return consensus.select("source_id", "consensus_rank").join(wide.withColumnsRenamed(names), "source_id")


@query(
    "jn_13_candidate_scores",
    f"""with {_RANKS}, ids as materialized (select distinct source_id from ranks where model_rank <= 100),
    s as materialized (select result_id, source_id, score from v_scores)
    select s.result_id, s.source_id, s.score from s join ids on ids.source_id = s.source_id""",
)
def jn_13(t):
    ids = _ranks(t).where("model_rank <= 100").select("source_id").distinct()
    return t.scores.join(ids, "source_id", "left_semi").select("result_id", "source_id", "score")


@query(
    "jn_12_export_rules",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}, {_OPPS}, w as (select eligible, case when eligible and source_id % 9 = 1 then null
        when not eligible and source_id % 11 = 1 then 0.5e0 when eligible then coalesce(score, 0e0) end score from opps)
    select count(*) filter (where eligible and score is null) eligible_without_score,
      count(*) filter (where not eligible and score is not null) ineligible_with_score from w""",
)
def jn_12_rules(t):
    """Faults put into the rows of an export: eligible ones without a score, ineligible ones with one."""
    _, opportunities = _opportunities(t)
    ninth, eleventh = F.col("source_id") % 9 == 1, F.col("source_id") % 11 == 1
    faulty = (
        F.when(F.col("eligible") & ninth, None).when(~F.col("eligible") & eleventh, 0.5)
        .when(F.col("eligible"), F.coalesce("score", F.lit(0.0)))
    )
    return joins.export_rules(opportunities.withColumn("score", faulty))


@query(
    "jn_13_model_order",
    """select result_id, row_number() over (order by holdout_average_precision desc nulls last, result_id) place
    from v_results""",
)
def jn_13_order(t):
    ordered = global_rank(
        t.results.select("result_id", "holdout_average_precision"),
        order=[F.desc_nulls_last("holdout_average_precision"), F.asc("result_id")],
        name="place",
    )
    return ordered.select("result_id", "place")


@query(
    "jn_14_model_evidence",
    f"""with {_RANKS} select r.source_id, r.result_id, m.role, m.dataset_variant, m.model, r.model_rank, r.score,
      1e0 / (coalesce((select max(60e0) from v_models), 60e0) + r.model_rank) rrf_contribution
    from ranks r join v_models m on m.result_id = r.result_id""",
)
def jn_14(t):
    ranks = _ranks(t).select("source_id", "result_id", "model_rank", "score")
    out = joins.evidence_rows(ranks, t.models.drop("variant_bit"), rrf_k=F.lit(60.0))
    return out.select(
        "source_id", "result_id", "role", "dataset_variant", "model", "model_rank", "score", "rrf_contribution"
    )


@query(
    "jn_14_stored_constant",
    f"""with {_RANKS}, k as (select result_id, case result_id when 'm1' then 60e0 when 'm2' then 30e0 end k from v_models)
    select r.source_id, r.result_id, r.model_rank, 1e0 / (coalesce(k.k, 60e0) + r.model_rank) rrf_contribution
    from ranks r join k on k.result_id = r.result_id""",
)
def jn_14_stored(t):
    """The constant is the one stored with the model; a model without one takes the default."""
    stored = t.models.select("result_id", F.expr("case result_id when 'm1' then 60e0 when 'm2' then 30e0 end").alias("k"))
    out = joins.evidence_rows(_ranks(t).select("source_id", "result_id", "model_rank"), stored, rrf_k=F.coalesce("k", F.lit(60.0)))
    return out.select("source_id", "result_id", "model_rank", "rrf_contribution")


@query(
    "jn_15_annotate_subtypes",
    """select l.source_id, target, case when target = 1 then spectral_type end spectral_type,
      case when target = 1 then main_id end main_id from v_label l left join v_ident i on i.source_id = l.source_id""",
)
def jn_15(t):
    attributes = ["spectral_type", "main_id"]
    joined = t.label.select("source_id", "target").join(t.ident.select("source_id", *attributes), "source_id", "left")
    positive = F.col("target") == 1
    return joined.withColumns({a: F.when(positive, F.col(a)) for a in attributes})


@query(
    "jn_16_positive_cohort",
    """select distinct i.source_id from v_ir i join v_wise w on w.source_id = i.source_id
    where i.sep_arcsec <= 1 and w.wise_cc_flags = '0000'""",
)
def jn_16(t):
    near = t.ir.where("sep_arcsec <= 1").select("source_id").distinct()
    return near.join(t.wise.where("wise_cc_flags = '0000'").select("source_id"), "source_id", "left_semi")


_PAIR_SQL = """, sets as (select distinct result_id s from members)
    select a.s left_set, b.s right_set,
      count(distinct case when l.result_id is not null and r.result_id is not null then k.source_id end) "intersection",
      count(distinct case when l.result_id is not null or r.result_id is not null then k.source_id end) as "union",
      count(distinct case when l.result_id is not null and r.result_id is not null then k.source_id end)
        / nullif(count(distinct case when l.result_id is not null or r.result_id is not null then k.source_id end), 0) jaccard,
      count(distinct case when l.result_id is not null and r.result_id is not null then k.source_id end)
        / nullif(count(distinct case when l.result_id is not null then k.source_id end), 0) left_retained
    from sets a cross join sets b cross join (select distinct source_id from members) k
      left join members l on l.result_id = a.s and l.source_id = k.source_id
      left join members r on r.result_id = b.s and r.source_id = k.source_id group by a.s, b.s"""


@query(
    "jn_17_model_jaccard",
    f"""with {_RANKS}, members as (select result_id, source_id from ranks where model_rank <= 500) {_PAIR_SQL}""",
)
def jn_17(t):
    bits = {m["result_id"]: i for i, m in enumerate(MODELS)}
    top = _ranks(t).where("model_rank <= 500")
    return joins.pairwise_overlap(joins.membership_mask(top, bits), bits)


@query(
    "jn_17_variant_overlap",
    f"""with members as (select 'm1' result_id, source_id from v_elig where compatible_mask & 1 <> 0 union all
      select 'm2', source_id from v_elig where compatible_mask & 2 <> 0 union all
      select 'm3', source_id from v_elig where compatible_mask & 256 <> 0) {_PAIR_SQL}""",
)
def jn_17_variants(t):
    bits = {m["result_id"]: m["variant_bit"] for m in MODELS}
    return joins.pairwise_overlap(t.elig, bits, mask="compatible_mask")


@query(
    "jn_18_run_overview",
    """with runs as (select run_id, min(price) created from v_results where model = 'xgboost' and price > 950
        group by run_id),
    best as (select run_id, count(*) n_results, max(holdout_average_precision) max_holdout_average_precision,
        max(holdout_recall_at_100) max_holdout_recall_at_100, max(hits_at_100) max_hits_at_100
      from v_results group by run_id),
    files as (select distinct run_id from v_results)
    select runs.run_id, created, coalesce(n_results, 0) n_results, max_holdout_average_precision,
      max_holdout_recall_at_100, max_hits_at_100, 'table' origin from runs left join best using (run_id)
    union all select f.run_id, null, n_results, max_holdout_average_precision, max_holdout_recall_at_100,
      max_hits_at_100, 'files' from files f left join best using (run_id)
      where f.run_id not in (select run_id from runs)""",
)
def jn_18(t):
    results = t.results
    runs = results.where("model = 'xgboost' and price > 950").groupBy("run_id").agg(F.min("price").alias("created"))
    metrics = ["holdout_average_precision", "holdout_recall_at_100", "hits_at_100"]
    return joins.run_overview(runs, results, metrics, results.select("run_id").distinct())


@query(
    "jn_19_tile_coverage",
    """select t.tile_id, status in ('completed', 'skipped') coverage_terminal,
      case status when 'completed' then 'effective' when 'skipped' then 'parent' else 'outstanding' end coverage_role,
      f.tile_id is not null and status = 'completed' effective
    from v_tiles t left join (select tile_id from v_tiles where written > 0) f on f.tile_id = t.tile_id""",
)
def jn_19(t):
    files = t.tiles.where("written > 0").select("tile_id", F.lit(True).alias("has_file"))
    return joins.coverage(t.tiles.join(files, "tile_id", "left")).select(
        "tile_id",
        "coverage_terminal",
        "coverage_role",
        (F.col("has_file").isNotNull() & (F.col("status") == "completed")).alias("effective"),
    )


@query(
    "jn_20_subtype_pairs",
    """select run_id, feature_set, max(case when model = 'xgboost' then holdout_average_precision end) wn_ap,
      count(*) filter (where model = 'xgboost') wn_n,
      max(case when model = 'random_forest' then holdout_average_precision end) wc_ap,
      count(*) filter (where model = 'random_forest') wc_n from v_results
    group by run_id, feature_set having count(*) filter (where model = 'xgboost') > 0
      and count(*) filter (where model = 'random_forest') > 0""",
)
def jn_20(t):
    named = t.results.withColumn(
        "subtype", F.when(F.col("model") == "xgboost", "wn").when(F.col("model") == "random_forest", "wc")
    ).withColumnRenamed("holdout_average_precision", "ap")
    return joins.subtype_pairs(named, ["run_id", "feature_set"], ["wn", "wc"], "ap")


# ---- duplicates -----------------------------------------------------------

_RADIUS = """k as (select *, count(*) over (partition by source_id) n,
      count(*) filter (where sep_arcsec <= 1.5) over (partition by source_id) n1,
      count(*) filter (where sep_arcsec <= 1.0) over (partition by source_id) n2 from v_ir)"""


@query(
    "dd_01_radius_rule",
    f"""with {_RADIUS} select source_id, tmass_id, sep_arcsec from k where n = 1 or (n1 = 1 and sep_arcsec <= 1.5)
      or (n1 > 1 and n2 = 1 and sep_arcsec <= 1.0)""",
)
def dd_01(t):
    resolved = dedup.resolve_by_radius(
        t.ir.select("source_id", "tmass_id", "sep_arcsec"), primary=1.5, secondary=1.0
    )
    return dedup.radius_kept(resolved)


@query(
    "dd_01_radius_stats",
    f"""with {_RADIUS}, g as (select source_id, max(n) n, max(n1) n1, max(n2) n2 from k group by source_id)
    select cast(sum(n) as bigint) n_input, count(*) n_groups, count(*) filter (where n = 1) n_singletons_kept,
      count(*) filter (where n > 1) n_dupe_groups, count(*) filter (where n > 1 and n1 = 1) n_resolved_at_primary,
      count(*) filter (where n > 1 and n1 > 1 and n2 = 1) n_resolved_at_secondary,
      count(*) filter (where n > 1 and n1 <> 1 and not (n1 > 1 and n2 = 1)) n_dropped_ambiguous from g""",
)
def dd_01_stats(t):
    return dedup.radius_stats(dedup.resolve_by_radius(t.ir, primary=1.5, secondary=1.0))


def _letters_sql(letters):
    return f"length(regexp_replace(substr(tmass_quality, 1, 3), '[^{letters}]', '', 'g'))"


@query(
    "dd_02_best_counterpart",
    f"""with r as (select *, {_letters_sql('AB')} ab, {_letters_sql('A')} a,
        coalesce(J_error, 'Infinity'::double) + coalesce(H_error, 'Infinity'::double)
          + coalesce(Ks_error, 'Infinity'::double) err, count(*) over (partition by source_id) n from v_ir),
    o as (select *, row_number() over (partition by source_id order by ab desc, a desc, err, tmass_id, J, H, Ks,
        J_error nulls first) rn from r)
    select source_id, tmass_id, J, H, Ks, tmass_quality, n tmass_candidate_count from o where rn = 1""",
)
def dd_02(t):
    return counterparts.best_counterpart(t.ir).select(
        "source_id", "tmass_id", "J", "H", "Ks", "tmass_quality", "tmass_candidate_count"
    )


@query(
    "dd_02_alternatives",
    """select source_id, array_to_string(list_sort(list(tmass_id)), ',') alternatives from v_ir group by source_id
    having count(*) > 1""",
)
def dd_02_alternatives(t):
    rows = F.from_json("tmass_alternatives_json", "array<struct<tmass_id:string>>")
    return counterparts.alternatives_json(t.ir).select(
        "source_id", F.array_join(F.sort_array(rows["tmass_id"]), ",").alias("alternatives")
    )


@query(
    "dd_03_first_by_type",
    """select source_id, tmass_quality, tmass_id from (select *, row_number() over (partition by source_id
      order by tmass_quality nulls last, tmass_id nulls last) rn from v_ir) where rn = 1""",
)
def dd_03(t):
    rows = t.ir.select("source_id", "tmass_quality", "tmass_id")
    return dedup.first_per_key(
        rows, ["source_id"], [dedup.nulls_last("tmass_quality"), dedup.nulls_last("tmass_id")]
    )


@query(
    "dd_04_keep_first",
    """select source_id, J, sep_arcsec from (select *, row_number() over (partition by source_id
      order by sep_arcsec, J) rn from v_ir) where rn = 1""",
)
def dd_04(t):
    return dedup.first_per_key(t.ir.select("source_id", "J", "sep_arcsec"), ["source_id"], ["sep_arcsec", "J"])


_OLD = """select 'b1' build, tile_id, region_no, source_id, source_hash from (select 'all' tile_id, region_no, source_id,
    md5(cast(source_id as string)) source_hash from v_core where parallax > 0)"""
_NEW = """select 'b1' build, tile_id, region_no, source_id, source_hash from (select 'all' tile_id, region_no + 100 region_no,
    source_id, md5(case when region_no = 7 then 'changed' else cast(source_id as string) end) source_hash
    from v_core where ruwe > 1.3)"""


@query(
    "dd_05_resumable_merge",
    f"""with u as (select *, 0 seq from ({_OLD}) union all select *, 1 from ({_NEW})),
    m as (select *, row_number() over (partition by build, tile_id, source_id order by seq desc) rn from u)
    select source_id, region_no, source_hash from m where rn = 1""",
)
def dd_05(t):
    merged, _ = dedup.merge_by_key(
        t.sql(_OLD), t.sql(_NEW), ["build", "tile_id", "source_id"], checksum="source_hash"
    )
    return merged.select("source_id", "region_no", "source_hash")


@query(
    "dd_05_merge_conflicts",
    f"""select source_id from (select * from ({_OLD}) union all select * from ({_NEW}))
    group by build, tile_id, source_id having count(distinct source_hash) > 1""",
)
def dd_05_conflicts(t):
    _, conflicts = dedup.merge_by_key(
        t.sql(_OLD), t.sql(_NEW), ["build", "tile_id", "source_id"], checksum="source_hash"
    )
    return conflicts.select("source_id")


@query(
    "dd_06_keyed_replace",
    """with old as (select result_id, coalesce(negative_ratio_label, '10x') ratio, coalesce(sampler, 'legacy_csv') sampler,
        cv_f2 from v_results where model <> 'xgboost'),
    new as (select result_id, coalesce(negative_ratio_label, '10x') ratio, coalesce(sampler, 'legacy_csv') sampler,
        train_f2 cv_f2 from v_results where selection_status = 'accepted')
    select * from old anti join new using (result_id, ratio, sampler) union all select * from new""",
)
def dd_06(t):
    c = F.col
    key = ["result_id", c("negative_ratio_label").alias("ratio"), "sampler"]
    old = t.results.where("model <> 'xgboost'").select(*key, "cv_f2")
    new = t.results.where("selection_status = 'accepted'").select(*key, c("train_f2").alias("cv_f2"))
    return dedup.replace_by_key(
        old, new, ["result_id", "ratio", "sampler"], {"ratio": "10x", "sampler": "legacy_csv"}
    )


_BEST = ["hits_at_100", "holdout_recall_at_100", "holdout_average_precision", "holdout_precision_at_100",
         "holdout_recall_at_low_fpr"]


@query(
    "dd_07_best_per_dataset",
    f"""select dataset_variant, result_id, hits_at_100 from (select *, row_number() over (partition by dataset_variant
      order by {', '.join(f'{c} desc nulls last' for c in _BEST)}, result_id) rn from v_results) where rn = 1""",
)
def dd_07(t):
    order = [dedup.nulls_last(-F.col(c)) for c in _BEST]
    rows = t.results.select("dataset_variant", "result_id", *_BEST)
    return dedup.first_per_key(rows, ["dataset_variant"], [*order, "result_id"]).select(
        "dataset_variant", "result_id", "hits_at_100"
    )
