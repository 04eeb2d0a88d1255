"""Tiling, incremental-run, source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raresift.operators import dedup, joins, ranking, tiles
from raresift.plans.audit_queries import ACQUIRED_SQL, TILE_OF, acquired
from raresift.plans.filter_queries import _NOT_NULL, quality_sql
from raresift.plans.locus_queries import UNION_SQL
from raresift.plans.rank_queries import _CONSENSUS, _FUSED, _RANKS, _ranks
from raresift.plans.registry import query
from raresift.session import cut_lineage, shared_dir
from raresift.sources import html, landing, store

ID_SQL = "replace(printf('ra%06.2f_%06.2f__dec%+06.2f_%+06.2f', r0, r1, d0, d1), '.', 'p')"
_GRID = f"""grid as (select {ID_SQL} tile_id, r0, r1, d0, d1 from (select i * 7e1 r0, least(i * 7e1 + 7e1, 36e1) r1,
      j * 5e1 - 9e1 d0, least(j * 5e1 - 4e1, 9e1) d1 from range(6) a(i), range(4) b(j))),
    held as (select {ID_SQL} tile_id, count(*) n from (select floor(ra / 7e1) * 7e1 r0, least(floor(ra / 7e1) * 7e1 + 7e1, 36e1) r1,
      floor(("dec" + 9e1) / 5e1) * 5e1 - 9e1 d0, least(floor(("dec" + 9e1) / 5e1) * 5e1 - 4e1, 9e1) d1 from v_core) group by 1)"""


@query(
    "tl_01_sky_grid",
    f"""with {_GRID}, parents as (select tile_id from held where n > (select avg(n) from held)),
    kids as (select p.tile_id parent_id, least(g.r0 + (i + 1) * 35e0, g.r1) r1, g.r0 + i * 35e0 r0, g.d0 + j * 25e0 d0,
        least(g.d0 + (j + 1) * 25e0, g.d1) d1 from grid g join parents p on p.tile_id = g.tile_id, range(2) a(i), range(2) b(j)
      where g.r0 + i * 35e0 < g.r1 and g.d0 + j * 25e0 < g.d1)
    select tile_id, cast(null as string) parent_id, r0 ra_min, r1 ra_max, d0 dec_min, d1 dec_max from grid
      where tile_id not in (select tile_id from parents)
    union all select {ID_SQL}, parent_id, r0, r1, d0, d1 from kids""",
)
def tl_01(t):
    grid = tiles.sky_grid(t.spark, 70.0, 50.0)
    held = tiles.assign_tiles(t.core.select("ra", "dec"), 70.0, 50.0).groupBy("tile_id").count()
    mean = held.agg(F.avg("count").alias("mean"))
    parents = held.join(F.broadcast(mean)).where("count > mean").select("tile_id")  # one row
    return tiles.with_children(grid, parents, 35.0, 25.0).select("tile_id", "parent_id", *tiles.BOX)


@query(
    "tl_02_subdivide_failed",
    f"""with f as (select * from v_tiles where status = 'failed' and ra_max - ra_min > 5 and dec_max - dec_min > 5),
    kids as (select f.tile_id parent, ra_min + i * 5e0 r0, least(ra_min + i * 5e0 + 5e0, ra_max) r1, dec_min + j * 5e0 d0,
      least(dec_min + j * 5e0 + 5e0, dec_max) d1 from f, range(2) a(i), range(2) b(j))
    select tile_id, ra_min, dec_min, case when status = 'failed' then 'skipped' else status end status,
      case when status = 'failed' then 'subdivided_into_subtiles' end note from v_tiles
    union all select {ID_SQL}, r0, d0, 'pending', concat('subtile_of:', parent) from kids""",
)
def tl_02(t):
    return tiles.subdivide_failed(t.tiles, 5.0, 5.0).select("tile_id", "ra_min", "dec_min", "status", "note")


_STATE = """st as (select tile_id, ts updated_at, status, bytes, n n_events from (select *, count(*) over (partition by tile_id) n,
    row_number() over (partition by tile_id order by ts desc, event_id desc) rn from v_tilelog) where rn = 1)"""


@query(
    "tl_03_stale_reset",
    f"""with {_STATE} select tile_id, case when status = 'running' and updated_at < timestamp '2024-01-30 12:00:00'
        - interval 30 minutes then 'failed' else status end status,
      case when status = 'running' and updated_at < timestamp '2024-01-30 12:00:00' - interval 30 minutes
        then 'stale_running_reset' end error_message from st""",
)
def tl_03(t):
    state = tiles.current_state(t.tilelog, ["status", "bytes"])
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return tiles.reset_stale(state, now, 30).select("tile_id", "status", "error_message")


@query("tl_04_current_state", f"with {_STATE} select tile_id, status, bytes, n_events, cast(updated_at as string) updated_at from st")
def tl_04(t):
    state = tiles.current_state(t.tilelog, ["status", "bytes"])
    return state.withColumn("updated_at", F.col("updated_at").cast("string"))


_PLAN = """select tile_id, pool_build_id, case when status = 'failed' then 'old' else 'new' end query_hash, 'c1' schema_hash from v_tiles"""
_MANIFEST = """select tile_id, status, written row_count, 'new' query_hash, case when pool_build_id = 'odd' and written % 3 = 0
    then 'c0' else 'c1' end schema_hash from v_tiles where status <> 'pending'"""
_MEASURED = "select tile_id, case when bytes % 5 = 0 then written + 1 else written end measured_rows from v_tiles"


@query(
    "tl_05_pending_tiles",
    f"""select * from (select p.tile_id, case when m.status is null then 'absent' when m.status <> 'completed' then 'incomplete'
      when p.query_hash <> m.query_hash then 'query_hash_changed' when p.schema_hash <> m.schema_hash
      then 'schema_hash_changed' when row_count <> measured_rows then 'row_count' end reason
      from ({_PLAN}) p left join ({_MANIFEST}) m on m.tile_id = p.tile_id left join ({_MEASURED}) x on x.tile_id = p.tile_id)
    where reason is not null""",
)
def tl_05(t):
    return tiles.pending_tiles(t.sql(_PLAN), t.sql(_MANIFEST), ["query_hash", "schema_hash"], t.sql(_MEASURED))


@query(
    "tl_07_build_status",
    """with e as (select tile_id from v_tiles where pool_build_id = 'even'), r as (select tile_id, status from v_tiles
        where pool_build_id = 'even' and status <> 'pending'),
    j as (select e.tile_id e, r.tile_id r, status from e full join r on r.tile_id = e.tile_id)
    select count(e) expected_tiles, count(r) registered_tiles, count(*) filter (where status = 'completed') completed_tiles,
      count(*) filter (where e is null or r is null or status <> 'completed') differences, 'partial' status from j""",
)
def tl_07(t):
    even = t.tiles.where("pool_build_id = 'even'")
    return tiles.build_status(even, even.where("status <> 'pending'"))


@query(
    "tl_07_build_status_whole",
    """select count(*) expected_tiles, count(*) registered_tiles, count(*) completed_tiles, 0 * count(*) differences,
      case when count(*) > 0 then 'completed' else 'partial' end status from v_tiles
      where pool_build_id = 'even' and status = 'completed'""",
)
def tl_07_whole(t):
    done = t.tiles.where("pool_build_id = 'even' and status = 'completed'")
    return tiles.build_status(done, done)


@query(
    "tl_08_backfill_status",
    """with d as (select * from v_tiles where pool_build_id = 'even' and status = 'completed'),
    x as (select pool_build_id, status from v_tiles union all select 'whole', status from d)
    select pool_build_id, case when pool_build_id = 'odd' then 'legacy' when n = e and f = e then 'completed' else 'partial' end status
    from (select pool_build_id, count(*) n, count(*) filter (where status = 'completed') f from x group by 1), (select count(*) e from d)""",
)
def tl_08(t):
    """A build with a status keeps it; of the others only the one that holds exactly the expected tiles, all completed, is promoted."""
    done = t.tiles.where("pool_build_id = 'even' and status = 'completed'")
    rows = t.tiles.unionByName(done.withColumn("pool_build_id", F.lit("whole")))
    builds = rows.groupBy("pool_build_id").agg(F.max(F.when(F.col("pool_build_id") == "odd", "legacy")).alias("status"))
    return tiles.backfill_status(builds, rows, expected_tiles=done.count())


@query(
    "tl_09_contract_violations",
    f"""with s as ({_MANIFEST}), i as ({_PLAN})
    select i.tile_id, 'query_hash' field, s.query_hash stored, i.query_hash incoming from i join s using (tile_id)
      where i.query_hash <> s.query_hash
    union all select i.tile_id, 'schema_hash', s.schema_hash, i.schema_hash from i join s using (tile_id)
      where i.schema_hash <> s.schema_hash""",
)
def tl_09(t):
    return tiles.contract_violations(t.sql(_MANIFEST), t.sql(_PLAN), "tile_id", ["query_hash", "schema_hash"])


@query(
    "tl_10_reconcile",
    """with a as (select region_no, source_id from v_core where parallax > 0), b as (select region_no, source_id from v_core
        where ruwe > 1.2), j as (select coalesce(a.region_no, b.region_no) region_no, a.source_id x, b.source_id y
      from a full join b on a.source_id = b.source_id and a.region_no = b.region_no)
    select region_no, count(*) filter (where y is null) only_left, count(*) filter (where x is null) only_right,
      count(*) filter (where x is not null and y is not null) shared, count(*) either,
      count(*) filter (where x is not null and y is not null) / count(*) jaccard from j group by region_no""",
)
def tl_10(t):
    a, b = t.core.where("parallax > 0"), t.core.where("ruwe > 1.2")
    return tiles.reconcile(a, b, ["region_no"])


@query(
    "wn_15_byte_budget",
    """with u as (select *, cast(sum(bytes) over (order by dec_min, ra_min) as bigint) used from v_tiles)
    select tile_id, used used_bytes, case when status = 'pending' and used - bytes >= 600000 then 'skipped' else status end status,
      case when status = 'pending' and used - bytes >= 600000 then 'byte_budget_reached' end note from u""",
)
def wn_15(t):
    return tiles.budget_status(t.tiles, 600_000, ["dec_min", "ra_min"]).select("tile_id", "used_bytes", "status", "note")


@query(
    "wn_16_runnable_tiles",
    "select tile_id, dec_min, ra_min from v_tiles where status in ('pending', 'failed') order by dec_min, ra_min limit 200",
)
def wn_16(t):
    runnable = t.tiles.where(F.col("status").isin("pending", "failed"))
    return runnable.orderBy("dec_min", "ra_min").limit(200).select("tile_id", "dec_min", "ra_min")


# ---- sources and sinks ---------------------------------------------------------------


def scratch(t, name):
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "src_01_land_csv",
    f"""select {TILE_OF} tile_id, count(*) n, round(sum(c.G), 6) sum_g, count(c.parallax) n_parallax from v_core c
    where source_id not in (select source_id from v_known) group by 1""",
)
def src_01(t):
    path = scratch(t, "landing")
    t.core.select(*landing.LANDING.names).write.option("header", True).csv(path)
    rows = landing.read_csv_tiles(t.spark, path)
    _, survivors = joins.exclude_known(rows, joins.label_map(t.known, last_wins=True))
    tile = F.concat(
        F.lit("t"), F.floor(F.col("ra") / 10.0).cast("string"), F.lit("_"),
        F.floor((F.col("dec") + 90.0) / 10.0).cast("string"),
    )
    return survivors.groupBy(tile.alias("tile_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("G"), 6).alias("sum_g"), F.count("parallax").alias("n_parallax")
    )


@query(
    "src_02_pool_views",
    f"""with {ACQUIRED_SQL} select 'acquisition_sources' view_name, count(*) n_rows from acq
    union all select 'pool_sources', count(*) from acq where passes and known_source_exclusion is null
    union all select 'effective_tiles', count(*) from v_tiles where status = 'completed'""",
)
def src_02(t):
    path = scratch(t, "pool")
    band = F.concat(F.lit("t"), F.floor(F.col("ra") / 30.0).cast("string"))
    columns = ["source_id", band.alias("tile_id"), "passes_any_exact_variant", "known_source_exclusion", "compatible_variant_mask"]
    landing.write_tiles(cut_lineage(acquired(t).select(*columns)), path)  # rows are read once for the ranges and once to be dealt
    views = landing.pool_views(t.spark, path, t.tiles)
    out = None
    for name, df in views.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "src_03_page_cells",
    r"""with x as (select page_id, unnest(regexp_extract_all(html, '(?s)<li><a href="([^"]*)">(.*?)</a></li>', 0)) cell,
      unnest(range(len(regexp_extract_all(html, '(?s)<li><a href="([^"]*)">(.*?)</a></li>', 0)))) pos from pages)
    select page_id, cast(pos as int) as "position", regexp_extract(cell, 'href="([^"]*)"', 1) target,
      nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cell, '<[^>]*>', '', 'g'), '&amp;', '&', 'g'),
        chr(160) || '|&nbsp;?', ' ', 'g'), '\s+', ' ', 'g')), '') as "text" from x""",
)
def src_03(t):
    return html.list_cells(t.pages)


@query(
    "src_03_page_version",
    r"""select page_id, coalesce(regexp_replace(nullif(regexp_extract(html, '(?i)<h1[^>]*>[^<]{0,40}', 0), ''), '\s+', ' ', 'g'), 'unknown') "version"
    from pages""",
)
def src_03_version(t):
    """The head line of a page stands for its version text; blanks are squeezed, pages without one are 'unknown'."""
    return html.page_version(t.pages, r"(?i)<h1[^>]*>[^<]{0,40}")


@query(
    "src_03_largest_table",
    """with c as (select page_id, 0 row_no, 0 col_no, 'page' as "text" from pages union all select page_id, 0, 1, 'url' from pages
      union all select page_id, 1, 0, cast(page_id as varchar) from pages union all select page_id, 1, 1, url from pages
      union all select page_id, 2, 0, '1.5' from pages union all select page_id, 2, 1, null from pages)
    select page_id, row_no, col_no, "text", try_cast("text" as double) as "number" from c""",
)
def src_03_table(t):
    """Each page gets a small and a larger table made of its own columns; the larger one is read, cell by cell."""
    small = F.lit("<table><tr><td>0</td></tr></table>")
    large = F.concat(
        F.lit("<TABLE class='a'><tr><th>page</th>\n<th>url</th></tr><TR><td> "), F.col("page_id").cast("string"),
        F.lit("\n</td><td><b>"), F.col("url"), F.lit("</b></td></TR><tr><td>1.5</td><td>&nbsp;</td></tr></TABLE>"),
    )
    return html.largest_table(t.pages.select("page_id", F.concat(F.col("html"), small, large, small).alias("html")))


@query(
    "src_04_rows_by_id",
    "select source_id, G, BP from v_core where source_id in (select source_id from v_known)",
)
def src_04(t):
    return landing.by_ids(t.core.select("source_id", "G", "BP"), t.known)


@query(
    "src_05_rows_by_type",
    """select main_id, main_type, query_type from (select *, row_number() over (partition by query_type order by main_id) n
      from (select distinct main_id, main_type, main_type query_type from v_ident where main_type in ('src1', 'src7')
        and main_id like 'obj-%')) where n <= 5""",
)
def src_05(t):
    archive = t.ident.where("main_id like 'obj-%'").select("main_id", "main_type")
    return landing.by_types(archive, ["src1", "src7"], type_column="main_type", order=["main_id"], row_limit=5)


@query(
    "src_06_write_check",
    f"""select concat('t', cast(cast(floor(ra / 3e1) as bigint) as string)) tile_id, count(*) planned_rows, count(*) n_rows, count(distinct source_id) n_sources, true write_ok
    from v_core group by 1""",
)
def src_06(t):
    path = scratch(t, "tiles")
    tile = F.concat(F.lit("t"), F.floor(F.col("ra") / 30.0).cast("string"))
    rows = t.core.select("source_id", "G", "BP", tile.alias("tile_id"))
    landing.write_tiles(rows, path)
    return landing.write_check(rows, landing.written_counts(t.spark, path))


@query(
    "src_06_write_check_faults",
    f"""select tile_id, count(*) planned_rows, cast(sum(copies) as bigint) n_rows, count(*) filter (where copies > 0) n_sources,
      min(copies) = 1 and max(copies) = 1 write_ok from (select concat('t', cast(cast(floor(ra / 3e1) as bigint) as string)) tile_id,
        case when floor(ra / 3e1) = 3 and source_id % 5 = 0 then 0 when floor(ra / 3e1) = 4 and source_id % 5 = 0 then 2
        else 1 end copies from v_core) group by 1""",
)
def src_06_faults(t):
    """One tile is written short and one with rows twice; the check names exactly these."""
    path = scratch(t, "tiles")
    zone = F.floor(F.col("ra") / 30.0)
    rows = t.core.select("source_id", "G", "BP", F.concat(F.lit("t"), zone.cast("string")).alias("tile_id"))
    fifth = F.col("source_id") % 5 == 0
    short = rows.where(~((F.col("tile_id") == "t3") & fifth))
    landing.write_tiles(short.unionByName(rows.where((F.col("tile_id") == "t4") & fifth)), path)
    return landing.write_check(rows, landing.written_counts(t.spark, path))


@query(
    "src_07_ranked_exports",
    f"""with {_RANKS}, {_FUSED}, {_CONSENSUS} select source_id, consensus_rank from consensus where consensus_rank <= 100""",
)
def src_07(t):
    path = scratch(t, "export")
    consensus = ranking.rrf_consensus(_ranks(t)).select("source_id", "consensus_rank")
    store.export_ranked(consensus, path, "consensus_rank", 100)
    return t.spark.read.option("header", True).schema("source_id long, consensus_rank long").csv(path)


@query("src_08_replace_tables", """select 'core' table_name, count(*) n_rows from v_core union all
    select 'labels', count(*) from v_label union all select 'nothing', count(*) from v_label where false""")
def src_08(t):
    root = scratch(t, "tables")
    frames = {"core": t.core, "labels": t.label, "nothing": t.label.select()}
    store.replace_tables(frames, root)
    store.replace_tables({"labels": t.label}, root)
    out = None
    for name in frames:
        df = t.spark.read.parquet(f"{root}/{name}")
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "src_09_append_evolving",
    """select result_id, cast(n_holdout as double) metric, cast(null as double) late, cast(p_partkey as string) config_sha256,
      cast(null as string) extra from v_results where model = 'xgboost'
    union all select result_id, holdout_average_precision, price, cast(p_partkey as string), run_id from v_results
      where model <> 'xgboost'""",
)
def src_09(t):
    c = F.col
    old = t.results.where("model = 'xgboost'").select(
        "result_id", c("n_holdout").cast("long").alias("metric"), F.lit(None).cast("int").alias("late"),
        c("p_partkey").alias("config_sha256"),
    )
    new = t.results.where("model <> 'xgboost'").select(
        "result_id", c("holdout_average_precision").alias("metric"), c("price").alias("late"),
        c("p_partkey").cast("string").alias("config_sha256"), c("run_id").alias("extra"),
    )
    return store.append_by_name(old, new)


@query(
    "src_10_register_runs",
    """select run_id, count(*) n, max(case when run_id = 'Brand#2' then 1 else 0 end) version from v_results
    where run_id in ('Brand#1', 'Brand#2') group by run_id""",
)
def src_10(t):
    path = scratch(t, "runs")
    rows = t.results.select("result_id", "run_id", F.lit(0).alias("version"))
    store.register_run(rows, path, "Brand#1")
    store.register_run(rows, path, "Brand#2")
    store.register_run(rows.withColumn("version", F.lit(1)), path, "Brand#2", replace=True)
    stored = t.spark.read.schema("result_id string, version int, run_id string").parquet(path)
    return stored.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


@query(
    "src_11_compact_copy",
    """select 'results' table_name, count(*) n_rows, 0 n_columns from v_results where run_id = 'Brand#3'
    union all select 'core', count(*), 3 from v_core""",
)
def src_11(t):
    out = store.compact_copy({"results": t.results, "core": t.core}, {"core": ["source_id", "G", "BP"]}, "Brand#3")
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(3 if name == "core" else 0).alias("n_columns")
        )
        for name, df in out.items()
    ]
    return counts[0].unionByName(counts[1])


@query("src_12_dataset_digest")
def src_12(t):
    """Same content in another order and partitioning gives the same digest."""
    a = store.digest(t.core).select(F.lit("as_is").alias("how"), "n_rows", "digest")
    b = store.digest(t.core.repartition(7, "region_no")).select(F.lit("shuffled").alias("how"), "n_rows", "digest")
    return a.unionByName(b)


@query(
    "src_12_digest_check",
    """select n as_is, n shuffled, n - 1 shortened, true same_when_shuffled, false same_when_shortened, false same_when_changed
    from (select count(*) n from v_core)""",
)
def src_12_check(t):
    """The digest ignores order and partitioning, and tells a missing row and a changed value."""
    first = t.core.agg(F.min("source_id").alias("least"))
    others = t.core.join(F.broadcast(first), F.col("source_id") != F.col("least")).select(t.core.columns)
    changed = t.core.withColumn("ruwe", F.when(F.col("region_no") == 7, F.col("ruwe") + 1).otherwise(F.col("ruwe")))
    digests = {
        "as_is": store.digest(t.core), "shuffled": store.digest(t.core.repartition(7, "region_no")),
        "shortened": store.digest(others), "changed": store.digest(changed),
    }
    one = None
    for name, digest in digests.items():  # one row each
        row = digest.select(F.col("n_rows").alias(name), F.col("digest").alias(f"digest_{name}"))
        one = row if one is None else one.join(F.broadcast(row))
    same = lambda name: (F.col("digest_as_is") == F.col(f"digest_{name}")).alias(f"same_when_{name}")
    return one.select("as_is", "shuffled", "shortened", same("shuffled"), same("shortened"), same("changed"))


@query(
    "src_13_snapshots",
    r"""select page_id, url, sha256(html) sha256, coalesce(nullif(regexp_extract(html, 'lang="[a-z]+"', 0), ''), 'unknown') version,
      cast(length(html) as int) n_chars from pages""",
)
def src_13(t):
    version = F.coalesce(F.nullif(F.regexp_extract("html", 'lang="[a-z]+"', 0), F.lit("")), F.lit("unknown"))
    return store.snapshot_rows(t.pages, version)


@query(
    "src_13_table_counts",
    """select 'ir' table_name, count(*) n_rows, (select count(*) from (select source_id from v_ir group by source_id
      having count(*) > 1)) repeated_ids from v_ir union all select 'core', count(*), 0 from v_core
    union all select 'known', count(*), (select count(*) from (select source_id from v_known group by source_id
      having count(*) > 1)) from v_known""",
)
def src_13_counts(t):
    return store.table_counts({"ir": t.ir, "core": t.core, "known": t.known}, "source_id")
