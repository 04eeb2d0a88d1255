"""Composed-job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from raresift.functions import text
from raresift.functions.photometry import VARIANTS
from raresift.operators import locus
from raresift.plans import jobs
from raresift.plans.audit_queries import CONTROLS_SQL, controls, sources
from raresift.plans.filter_queries import _NOT_NULL, REQUIRED, astrometry_sql, quality_sql
from raresift.plans.locus_queries import FEATURE_SETS, LOCI, SCHEMA, T_SQL, VALID_SQL
from raresift.plans.registry import query
from raresift.plans.tile_queries import scratch
from raresift.session import cut_lineage

# Catalogue entries name a source by an alias built from the document number.
_CAT = """select source_id doc, main_id, main_type, other_types, spectral_type,
    case when other_types = 'en' then concat('DR3 ', cast(source_id * 10 + 1 as string)) else concat('x Gaia DR3 ',
      cast(source_id * 10 + 2 as string)) end alias from v_ident"""

_KEEP = """kept as (select source_id from (select i.*, count(*) over (partition by i.source_id) n,
      count(*) filter (where sep_arcsec <= 1.5) over (partition by i.source_id) n1,
      count(*) filter (where sep_arcsec <= 1.0) over (partition by i.source_id) n2 from v_ir i
      where i.source_id in (select source_id from ref)) where n = 1 or (n1 = 1 and sep_arcsec <= 1.5)
      or (n1 > 1 and n2 = 1 and sep_arcsec <= 1.0))"""
_TAIL = """union all select 'core_sources', 'id', count(*) from v_core where source_id in (select source_id from ref)
    union all select 'infrared_matches', 'id+radius', count(*) from kept
    union all select 'wise_matches', 'id', count(*) from v_wise where source_id in (select source_id from ref)"""


def _catalogue(t):
    return t.sql(_CAT).drop("doc")


@query(
    "job_01_build_reference",
    f"""with cat as ({_CAT}), ref as (select distinct doc * 10 + 1 source_id from cat where other_types = 'en'), {_KEEP}
    select 'catalogue_raw' stage, 'snapshot' as "method", count(*) n_rows from cat
    union all select 'reference', 'alias', count(*) from ref {_TAIL}""",
)
def job_01(t):
    return jobs.build_reference(_catalogue(t), F.col("alias"), t.core, t.ir, t.wise, scratch(t, "reference"))


@query(
    "job_02_build_negatives",
    f"""with cat as ({_CAT}), raw as (select distinct doc * 10 + 2 source_id, spectral_type from cat where other_types <> 'en'
        and main_type in ('src1', 'src2', 'src3')),
    ref as (select distinct source_id from raw where not regexp_matches(coalesce(spectral_type, ''), '(?i)wc7')
      and source_id not in (select source_id from v_known)), {_KEEP}
    select 'negative_raw' stage, 'type' as "method", count(*) n_rows from raw
    union all select 'negative_sources', 'exclusion', count(*) from ref {_TAIL}""",
)
def job_02(t):
    return jobs.build_negatives(
        _catalogue(t), ["src1", "src2", "src3"], text.searched_id(F.col("alias")), t.known, t.core, t.ir, t.wise,
        scratch(t, "negatives"), exclude=["wc7"],
    )


@query("job_03_filter_audit")
def job_03(t):
    """Comparison and audit tables written from one pass over the rows."""
    pool = t.pool.withColumn("region", F.concat(F.lit("reg"), F.col("region_no").cast("string")))
    return jobs.audit_policies(pool, LOCI, SCHEMA, FEATURE_SETS, scratch(t, "audit"))


_MEMBER_SQL = " ".join(
    f"when '{v}' then {_NOT_NULL} and {quality_sql(v.split('_', 1)[0])} and {astrometry_sql(v.split('_', 1)[1])}" for v in VARIANTS
)
_PLANES = [f"{x}__{y}" for x, y in locus.PLANES]
_POINTS_SQL = " union all ".join(f"select variant, '{x}__{y}' plane, t_{x} tx, t_{y} ty from mem where positive" for x, y in locus.PLANES)
_WIDE_SQL = ", ".join(f"max(case when fit.plane = '{p}' then {c} end) {c}{i}" for i, p in enumerate(_PLANES) for c in ("s", "b", "q"))
_OUTSIDE_SQL = " + ".join(
    f"case when q{i} - abs(t_{y} - (b{i} + s{i} * t_{x})) < 0 then 1 else 0 end" for i, (x, y) in enumerate(locus.PLANES)
)


@query(
    "job_04_fit_variants",
    f"""with {T_SQL}, mem as (select t.*, variant, source_id in (select source_id from v_known where label = 'known_wr') positive
      from t, (values {", ".join(f"('{v}')" for v in VARIANTS)}) x(variant) where case variant {_MEMBER_SQL} end),
    pts as ({_POINTS_SQL}),
    fit as (select variant, plane, count(*) n_rows, count(tx + ty) n, regr_slope(ty, tx) s, regr_intercept(ty, tx) b from pts group by 1, 2),
    res as (select pts.variant, pts.plane, quantile_cont(abs(ty - (b + s * tx)), 0.975) q from pts join fit on fit.variant = pts.variant
      and fit.plane = pts.plane where tx is not null and ty is not null group by 1, 2),
    pv as (select fit.variant, count(*)::int planes, {_WIDE_SQL} from fit join res on res.variant = fit.variant and res.plane = fit.plane
      where n = n_rows group by fit.variant),
    j as (select positive, mem.variant, planes, {VALID_SQL} v, {_OUTSIDE_SQL} n from mem join pv on pv.variant = mem.variant)
    select positive, variant, planes, count(*) n_rows, count(*) filter (where n >= 2) outliers, count(*) filter (where v and n < 2) kept
    from j group by positive, variant, planes""",
)
def job_04(t):
    """Twelve nested variants: bands fitted on the positives of each, both classes judged and counted."""
    ids = t.known.where("label = 'known_wr'").select("source_id").distinct()
    return jobs.fit_variants(t.pool, ids, REQUIRED)


_TILE = "concat('t', cast(cast(floor(ra / 3e1) as bigint) as string))"


@query(
    "tl_06_build_pool",
    f"""select {_TILE} tile_id, 'completed' status, count(*) row_count, case when {_TILE} = 't3' then 'q2' else 'q1' end query_hash,
      {_TILE} = 't3' redone from v_pool group by 1""",
)
def tl_06(t):
    """Build all tiles, then run again after one tile's contract changed: only that tile is redone."""
    return _built(t)[0].select("tile_id", "status", "row_count", "query_hash", "redone")


@query("tl_06_manifest", f"select count(distinct {_TILE}) n_tiles, count(*) n_rows from v_pool")
def tl_06_manifest(t):
    _, plan, root = _built(t)
    return jobs.finalise_pool(t.spark, plan, root).select("n_tiles", "n_rows")


def _landed_pool(t):
    """The landed rows with their tile, joined once for all builds, and the plan of their tiles."""
    rows = t.landed_pool().withColumn("tile_id", F.concat(F.lit("t"), F.floor(F.col("ra") / 30.0).cast("string")))
    return rows, cut_lineage(rows.select("tile_id").distinct().withColumn("query_hash", F.lit("q1")))


def _built(t):
    (rows, plan), root = _landed_pool(t), scratch(t, "pool")
    jobs.build_pool(rows, plan, t.known, LOCI, SCHEMA, root, confirm_full_build=True)
    changed = plan.withColumn("query_hash", F.when(F.col("tile_id") == "t3", "q2").otherwise("q1"))
    return jobs.build_pool(rows, changed, t.known, LOCI, SCHEMA, root, confirm_full_build=True), changed, root


@query(
    "tl_06_bounded_builds",
    f"""with c as (select {_TILE} tile_id, count(*) n, row_number() over (order by {_TILE}) place from v_pool group by 1)
    select tile_id, n row_count, case when place <= 3 then 1 when place <= 7 then 2 else 3 end version from c""",
)
def tl_06_bounded(t):
    """Three tiles, then four, then the rest; after each build the rows of all published tiles are counted from the files."""
    rows, plan = _landed_pool(t)
    root, table, counts = scratch(t, "pool"), None, None
    for number, bound in enumerate((3, 4, None), 1):
        jobs.build_pool(rows, plan, t.known, LOCI, SCHEMA, root, max_tiles=bound, confirm_full_build=bound is None)
        held = cut_lineage(jobs.pool_table(t.spark, root).rows().groupBy("tile_id").agg(F.count(F.lit(1)).alias("row_count")))
        held = held.withColumn("version", F.lit(number))
        counts = held if counts is None else counts.unionByName(held)
    return counts.groupBy("tile_id").agg(F.max("row_count").alias("row_count"), F.min("version").alias("version"))


@query(
    "tl_06_failed_build",
    f"select {_TILE} tile_id, count(*) row_count, sum(source_id % 1000)::bigint id_sum from v_pool group by 1",
)
def tl_06_failed(t):
    """A rebuild whose rows are not those planned (a source comes twice) is refused; readers still see the tiles of the first build."""
    rows, plan = _landed_pool(t)
    root = scratch(t, "pool")
    jobs.build_pool(rows, plan, t.known, LOCI, SCHEMA, root, confirm_full_build=True)
    twice = rows.unionByName(rows.where("source_id % 50 = 1"))
    try:
        jobs.build_pool(twice, plan.withColumn("query_hash", F.lit("q2")), t.known, LOCI, SCHEMA, root, confirm_full_build=True)
    except ValueError:
        pass
    else:
        raise AssertionError("a build with repeated sources was published")
    return jobs.pool_table(t.spark, root).rows().groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("source_id") % 1000).alias("id_sum")
    )


@query(
    "jn_21_known_controls",
    f"""with {CONTROLS_SQL} select c.source_id, i.spectral_type, env acquisition_envelope_keep, cur current_policy_keep,
      ex exact_union_policy_keep from ctl c left join (select source_id * 10 + 1 source_id, spectral_type from v_ident) i
      on i.source_id = c.source_id""",
)
def jn_21(t):
    identity = t.ident.select((F.col("source_id") * 10 + 1).alias("source_id"), "spectral_type")
    flags = ["acquisition_envelope_keep", "current_policy_keep", "exact_union_policy_keep"]
    return controls(t).select("source_id", *flags).join(identity, "source_id", "left")
