"""Ranking, fusion, curve and threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.operators import curves, ranking
from raresift.operators.ordered import average_rank, global_rank
from raresift.plans.registry import query
from raresift.session import cut_lineage

# The explicit model selection: (result_id, variant bit), a handful of literals.
MODELS = (
    {"result_id": "m1", "variant_bit": 0},
    {"result_id": "m2", "variant_bit": 1},
    {"result_id": "m3", "variant_bit": 8},
)
TOP = 1000

_RANKS = f"""ranks as (select * from (select *, row_number() over (partition by result_id
    order by score desc, source_id) model_rank from v_scores) where model_rank <= {TOP})"""
_FUSED = """fused as (select source_id, round(sum(1e0 / (60e0 + model_rank)), 12) rrf_score,
    count(distinct result_id) model_support, count(distinct dataset_variant) variant_support,
    count(distinct model) estimator_support, min(model_rank) best_model_rank, avg(model_rank) mean_model_rank
    from ranks group by source_id)"""
_CONSENSUS = """consensus as (select *, row_number() over (order by rrf_score desc, model_support desc,
    variant_support desc, best_model_rank, source_id) consensus_rank from fused)"""
_OPPS = f"""opps as (
    select e.source_id, m.result_id, m.variant_bit,
      (locus_mask & b.v) <> 0 locus_keep, (photometry_mask & b.v) <> 0 photometry_keep,
      (astrometry_mask & b.v) <> 0 astrometry_keep, (compatible_mask & b.v) <> 0 eligible,
      r.model_rank, r.score
    from v_elig e join consensus c on c.source_id = e.source_id cross join v_models m
      join (values ('m1', 1), ('m2', 2), ('m3', 256)) b(id, v) on b.id = m.result_id
      left join ranks r on r.source_id = e.source_id and r.result_id = m.result_id)"""


def _ranks(t):
    return ranking.model_ranks(t.scores, limit=TOP)


def _ranks_once(t):
    """The short lists, at most TOP rows per model, written once where several steps read them."""
    return cut_lineage(_ranks(t))


@query("wn_01_model_top_n", f"with {_RANKS} select result_id, source_id, score, model_rank from ranks")
def wn_01(t):
    return _ranks(t).select("result_id", "source_id", "score", "model_rank")


@query(
    "ag_05_rrf_consensus",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}
    select source_id, rrf_score, model_support, variant_support, estimator_support, best_model_rank,
      round(mean_model_rank, 6) mean_model_rank, consensus_rank from consensus""",
)
def ag_05(t):
    return ranking.rrf_consensus(_ranks(t)).withColumn("mean_model_rank", F.round("mean_model_rank", 6))


@query(
    "wn_02_followup_ranks",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS},
    kept as (select source_id, consensus_rank from consensus
      where source_id not in (select source_id from v_known))
    select source_id, consensus_rank, row_number() over (order by consensus_rank) followup_rank,
      case when row_number() over (order by consensus_rank) <= 20 then 'headline'
        when row_number() over (order by consensus_rank) <= 100 then 'deep' else 'review' end tier
    from kept""",
)
def wn_02(t):
    consensus = ranking.rrf_consensus(_ranks(t)).select("source_id", "consensus_rank")
    kept = consensus.join(t.known.select("source_id"), "source_id", "left_anti")
    ranked = global_rank(kept, order=[F.asc("consensus_rank")], name="followup_rank")
    return ranked.withColumn(
        "tier",
        F.when(F.col("followup_rank") <= 20, "headline").when(F.col("followup_rank") <= 100, "deep").otherwise("review"),
    )


def _opportunities(t):
    ranks = _ranks_once(t)
    consensus = ranking.rrf_consensus(ranks)
    sources = t.elig.join(consensus.select("source_id"), "source_id", "left_semi")
    return consensus, ranking.model_opportunities(sources, MODELS, ranks, limit=TOP)


@query(
    "jn_09_eligibility_consensus",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}, {_OPPS},
    support as (select source_id, count(*) filter (where eligible) eligible_model_count,
      count(model_rank) ranked_model_count from opps group by source_id),
    enriched as (select c.source_id, consensus_rank, rrf_score, model_support, best_model_rank,
      eligible_model_count, ranked_model_count,
      ranked_model_count / nullif(eligible_model_count, 0) eligible_support_fraction,
      rrf_score / nullif(eligible_model_count, 0) eligibility_normalized_rrf
      from consensus c join support s on c.source_id = s.source_id)
    select *, row_number() over (order by eligibility_normalized_rrf desc, eligible_support_fraction desc,
      model_support desc, best_model_rank, source_id) eligibility_rank from enriched""",
)
def jn_09(t):
    consensus, opportunities = _opportunities(t)
    return ranking.eligibility_consensus(consensus, opportunities).select(
        "source_id", "consensus_rank", "rrf_score", "model_support", "best_model_rank", "eligible_model_count",
        "ranked_model_count", "eligible_support_fraction", "eligibility_normalized_rrf", "eligibility_rank",
    )


@query(
    "jn_09_model_opportunities",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS}, {_OPPS}
    select source_id, result_id, variant_bit, locus_keep, photometry_keep, astrometry_keep, eligible, model_rank, score,
      case when model_rank is not null then 'ranked_top_{TOP}' when eligible then 'eligible_below_top_{TOP}'
        else 'ineligible_variant' end model_status,
      case when eligible then 'passed_all_variant_filters' else concat('failed_', concat_ws('+',
        case when not locus_keep then 'locus' end, case when not photometry_keep then 'photometry_quality' end,
        case when not astrometry_keep then 'astrometry' end)) end eligibility_reason,
      case when model_rank is not null then 1e0 / (60e0 + model_rank) else 0e0 end rrf_contribution
    from opps""",
)
def jn_09_long(t):
    return _opportunities(t)[1]


@query(
    "wn_06_pass_first",
    """with v as (select source_id, score, (BUCKET(concat('pass', cast(source_id as string))) % 3) <> 0 passed
        from v_pred where result_id = 'm1'),
    b as (select *, row_number() over (order by score desc, source_id) rank_before from v),
    a as (select *, row_number() over (order by passed desc, rank_before) rank_after from b)
    select *, rank_before - rank_after rank_delta from a""",
)
def wn_06(t):
    scored = t.sql(
        """select source_id, score, (BUCKET(concat('pass', cast(source_id as string))) % 3) <> 0 passed
        from v_pred where result_id = 'm1'"""
    )
    return ranking.pass_first_ranks(scored)


_STEPS = """d as (select result_id, score, count(*) filter (where target = 1) pos,
      count(*) filter (where target = 0) neg from v_pred group by result_id, score),
    steps as (select *, cast(sum(pos) over w as bigint) tp, cast(sum(neg) over w as bigint) fp,
      row_number() over w step, cast(sum(pos) over (partition by result_id) as bigint) positives,
      cast(sum(neg) over (partition by result_id) as bigint) negatives,
      count(*) over (partition by result_id) steps
      from d window w as (partition by result_id order by score desc))"""


def _steps(t):
    return curves.score_steps(t.pred, ["result_id"])


@query(
    "wn_07_pr_curve",
    f"""with {_STEPS} select result_id, tp / positives recall, tp / (tp + fp) as "precision", score from steps
    union all select distinct result_id, 0e0, 1e0, cast(null as double) from steps""",
)
def wn_07(t):
    return curves.pr_points(_steps(t), ["result_id"]).drop("point", "steps")


@query(
    "wn_08_roc_curve",
    f"""with {_STEPS}, n as (select *, lead(pos) over (partition by result_id order by step) np,
      lead(neg) over (partition by result_id order by step) nn from steps)
    select result_id, fp / negatives fpr, tp / positives tpr, score from n
      where step = 1 or step = steps or np <> pos or nn <> neg
    union all select distinct result_id, 0e0, 0e0, cast(null as double) from steps""",
)
def wn_08(t):
    return curves.roc_points(_steps(t), ["result_id"])


@query(
    "wn_09_curve_downsample",
    f"""with {_STEPS}, c as (select result_id, step point, tp / positives recall,
        tp / (tp + fp) as "precision", steps from steps
      union all select distinct result_id, 0, 0e0, 1e0, steps from steps),
    pick as (select distinct result_id, case when i = 39 then steps
        else cast(floor(i * (steps / 39e0)) as bigint) end point
      from (select distinct result_id, steps from steps), range(40) r(i))
    select c.result_id, c.point, recall, "precision" from c where steps < 40
      or exists (select 1 from pick p where p.result_id = c.result_id and p.point = c.point)""",
)
def wn_09(t):
    curve = curves.pr_points(_steps(t), ["result_id"])
    return curves.downsample(curve, ["result_id"], 40).drop("score", "steps")


@query(
    "wn_10_operating_point",
    """select result_id, coalesce(tp / nullif(p, 0), 0) recall, coalesce(tp / nullif(tp + fp, 0), 0) as "precision",
      coalesce(fp / nullif(n, 0), 0) fpr, coalesce(tp / nullif(p, 0), 0) tpr, score from (
      select result_id, count(*) filter (where score >= threshold and target = 1) tp,
        count(*) filter (where score >= threshold and target = 0) fp, count(*) filter (where target = 1) p,
        count(*) filter (where target = 0) n, max(threshold) score from v_pred group by result_id)
    where p > 0 and n > 0""",
)
def wn_10(t):
    return curves.operating_point(t.pred, ["result_id"], F.col("threshold"))


@query(
    "wn_11_average_precision_auc",
    f"""with {_STEPS} select result_id, round(sum(pos / positives * (tp / (tp + fp))), 6) average_precision,
      round(sum(neg / negatives * (tp - pos / 2e0) / positives), 6) roc_auc from steps group by result_id""",
)
def wn_11(t):
    return curves.area_metrics(_steps(t), ["result_id"])


@query(
    "wn_12_budget_metrics",
    """with r as (select result_id, target, row_number() over (partition by result_id
        order by score desc, source_id) rank, count(*) over (partition by result_id) n,
        count(*) filter (where target = 1) over (partition by result_id) p from v_pred),
    k as (select unnest([10, 50, 100, 500])::bigint k)
    select result_id, k, count(*) filter (where rank <= k and target = 1) hits,
      count(*) filter (where rank <= k and target = 1) / least(k, max(n)) precision_at_k,
      coalesce(count(*) filter (where rank <= k and target = 1) / nullif(max(p), 0), 0) recall_at_k,
      least(k, max(n)) / nullif(count(*) filter (where rank <= k and target = 1), 0) candidates_per_hit
    from r, k group by result_id, k""",
)
def wn_12(t):
    return curves.budget_metrics(t.pred, ["result_id"], [10, 50, 100, 500])


@query(
    "wn_12_recall_at_fpr",
    f"""with {_STEPS}, l as (select unnest([0.0001, 0.005, 0.01, 0.05])::double as level)
    select result_id, level,
      coalesce(max(tp / positives) filter (where fp <= floor(level * negatives)), 0) recall,
      coalesce(min(score) filter (where fp <= floor(level * negatives)), 'Infinity'::double) threshold
    from steps, l group by result_id, level""",
)
def wn_12_fpr(t):
    return curves.recall_at_fpr(_steps(t), ["result_id"], [0.0001, 0.005, 0.01, 0.05])


@query(
    "wn_13_select_threshold",
    f"""with {_STEPS}, m as (select result_id, score threshold, tp / (tp + fp) p, tp / positives r,
        (tp + negatives - fp) / (positives + negatives) acc,
        (tp / positives + (negatives - fp) / negatives) / 2e0 bal from steps),
    f as (select *, coalesce(5e0 * p * r / nullif(4e0 * p + r, 0), 0) fb from m),
    tier as (select *, case when p >= 0.9 and acc >= 0.5 and bal >= 0.5 then 1
      when acc >= 0.5 and bal >= 0.5 then 2 else 3 end tier from f),
    best as (select *, min(tier) over (partition by result_id) bt from tier),
    pick as (select *, row_number() over (partition by result_id order by
      case bt when 1 then fb else p end desc,
      case bt when 1 then r when 2 then fb else acc end desc,
      case bt when 1 then p when 2 then r else bal end desc, case bt when 3 then fb end desc, threshold) rn
      from best where (bt = 1 and tier = 1) or (bt = 2 and tier <= 2) or bt = 3)
    select result_id, threshold, p as "precision", r recall, fb f_beta, acc accuracy, bal balanced_accuracy,
      p >= 0.9 precision_floor_met, acc >= 0.5 accuracy_floor_met, bal >= 0.5 balanced_accuracy_floor_met
    from pick where rn = 1""",
)
def wn_13(t):
    return curves.select_threshold(
        _steps(t), ["result_id"], min_precision=0.9, min_accuracy=0.5, min_balanced_accuracy=0.5
    )


_RANKED = """ranked as (select *, row_number() over (partition by result_id order by score desc, source_id) rank,
    cast(score >= threshold as int) predicted from v_pred)"""


def _ranked(t):
    return global_rank(
        t.pred, by=["result_id"], order=[F.desc("score"), F.asc("source_id")], name="rank"
    ).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))


@query(
    "wn_14_case_states",
    f"""with {_RANKED} select result_id, source_id, rank,
      case when target = 1 and rank <= 50 then 'WR recovered @K' when target = 0 and rank <= 50 then 'Contaminant @K'
        when target = 1 then 'WR outside @K' else 'Background' end budget_state,
      case when target = 1 and predicted = 1 then 'True positive' when predicted = 1 then 'False positive'
        when target = 1 then 'False negative' else 'True negative' end threshold_state from ranked""",
)
def wn_14(t):
    ranked = _ranked(t)
    both = curves.case_states(
        curves.case_states(ranked, top_k=50).withColumnRenamed("diagnostic_state", "budget_state"),
        basis="operating_threshold",
    )
    return both.select(
        "result_id", "source_id", "rank", "budget_state", F.col("diagnostic_state").alias("threshold_state")
    )


@query(
    "ag_06_case_overlap",
    f"""with {_RANKED}, total as (select count(distinct result_id) n_total_models from ranked),
    kinds as (select 'false_positive' kind, * from ranked where target = 0 and rank <= 50
      union all select 'missed_wr', * from ranked where target = 1 and rank > 50)
    select kind, source_id, max(target) target, count(*) n_models, round(avg(score), 6) score_mean, min(rank) best_rank,
      max(rank) worst_rank, max(n_total_models) n_total_models, count(*) / max(n_total_models) model_share
    from kinds, total group by kind, source_id""",
)
def ag_06(t):
    ranked = _ranked(t)
    kind = F.when((F.col("target") == 0) & (F.col("rank") <= 50), "false_positive").when(
        (F.col("target") == 1) & (F.col("rank") > 50), "missed_wr"
    )
    flagged = ranked.withColumn("kind", kind).where(F.col("kind").isNotNull())
    total = t.pred.agg(F.count_distinct("result_id").alias("n_total_models"))
    return (
        flagged.groupBy("kind", "source_id")
        .agg(
            F.max("target").alias("target"),
            F.count(F.lit(1)).alias("n_models"),
            F.round(F.avg("score"), 6).alias("score_mean"),
            F.min("rank").alias("best_rank"),
            F.max("rank").alias("worst_rank"),
        )
        .join(F.broadcast(total))  # one row
        .withColumn("model_share", F.col("n_models") / F.col("n_total_models"))
    )


@query(
    "ag_09_confusion",
    f"""with {_RANKED}, c as (select result_id, count(*) filter (where target = 1 and predicted = 1) tp,
      count(*) filter (where target = 0 and predicted = 1) fp, count(*) filter (where target = 1 and predicted = 0) fn,
      count(*) filter (where target = 0 and predicted = 0) tn from ranked group by result_id)
    select *, coalesce(tp / nullif(tp + fp, 0), 0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0) recall,
      coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) f2,
      (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2e0 balanced_accuracy,
      (tp + tn) / (tp + fp + fn + tn) accuracy from c""",
)
def ag_09(t):
    pred = t.pred.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return curves.confusion(pred, ["result_id"])
