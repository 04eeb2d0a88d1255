"""Composed jobs: catalogues end to end, pool builds, filter audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raresift.functions import photometry as ph, text
from raresift.operators import audits, dedup, filters, joins, locus, tiles, zone_join
from raresift.operators.joins import pairwise_overlap
from raresift.session import cut_lineage, settle, turns_of
from raresift.sources import landing, store
from raresift.sources.staged import StagedTable


def _enrich(ids: DataFrame, core: DataFrame, infrared: DataFrame, wise: DataFrame) -> dict[str, DataFrame]:
    """Archive rows of an id list; counterparts resolved by radius."""
    resolved = dedup.resolve_by_radius(landing.by_ids(infrared, ids), primary=1.5, secondary=1.0)
    return {
        "core_sources": landing.by_ids(core, ids),
        "infrared_matches": dedup.radius_kept(resolved),
        "wise_matches": landing.by_ids(wise, ids),
    }


def stage_log(root: str, spark, stages: Mapping[str, str]) -> DataFrame:
    """(stage, method, rows) of every written table, counted from the files."""
    out = None
    for name, method in stages.items():
        one = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("stage"), F.lit(method).alias("method"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


def build_reference(catalogue: DataFrame, alias: Column, core, infrared, wise, root: str) -> DataFrame:
    """Positive catalogue: ids from aliases, archive rows, counterparts, tables, stage log."""
    with_id = catalogue.withColumn("source_id", text.strict_id(alias)).where(F.col("source_id").isNotNull())
    reference = dedup.first_per_key(with_id, ["source_id"], ["main_id"])
    tables = {"catalogue_raw": catalogue, "reference": reference, **_enrich(reference, core, infrared, wise)}
    store.replace_tables(tables, root)
    return stage_log(
        root, catalogue.sparkSession,
        {"catalogue_raw": "snapshot", "reference": "alias", "core_sources": "id", "infrared_matches": "id+radius",
         "wise_matches": "id"},
    )


def build_negatives(
    catalogue: DataFrame, types: Sequence[str], ids: Column, positives: DataFrame, core, infrared, wise, root: str,
    *, exclude: Sequence[str],
) -> DataFrame:
    """Negative catalogue: rows by type, ids, exclusion of positives, one row per source, enrichment."""
    raw = landing.by_types(catalogue, types, type_column="main_type", order=["main_id"])
    named = raw.withColumn("source_id", ids).where(F.col("source_id").isNotNull())
    allowed = filters.exclude_types(
        named, known_ids=positives.select("source_id").distinct(), columns=["main_type", "spectral_type"], tokens=exclude
    )
    one = dedup.first_per_key(allowed, ["source_id"], [dedup.nulls_last("query_type"), dedup.nulls_last("main_id")])
    tables = {"negative_raw": named, "negative_sources": one, **_enrich(one, core, infrared, wise)}
    store.replace_tables(tables, root)
    return stage_log(
        root, catalogue.sparkSession,
        {"negative_raw": "type", "negative_sources": "exclusion", "core_sources": "id", "infrared_matches": "id+radius",
         "wise_matches": "id"},
    )


def fit_variants(pool: DataFrame, positive_ids: DataFrame, required: Sequence[str], *, quantile: float = 0.975,
                 min_outlier_planes: int = 2) -> DataFrame:
    """All variants at once: fit on positives, judge both classes, count.

    The fits of the twelve nested datasets share one plan; at most planes times
    variants rows of parameters reach the driver.
    """
    rows = ph.with_colours(pool, ph.LOCAL_COLOURS).join(
        positive_ids.withColumn("__pos", F.lit(True)), "source_id", "left"
    ).withColumn("positive", F.coalesce("__pos", F.lit(False))).drop("__pos")
    rules = locus.variant_rules(required)
    rows = cut_lineage(
        rows.withColumns({f"in__{v}": rule for v, rule in rules.items()}).select(
            "source_id", "positive", *locus.PLANE_COLOURS, *[f"in__{v}" for v in rules]
        )
    )
    names = F.array_compact(F.array(*[F.when(F.col(f"in__{v}"), v) for v in rules]))
    positives = rows.where("positive").withColumn("variant", F.explode(names))
    fits = locus.fit_planes(positives, by=["variant"], quantile=quantile).where("valid").collect()
    bands: dict[str, list[locus.Band]] = {}
    for f in fits:
        bands.setdefault(f["variant"], []).append(
            locus.Band(f["x"], f["y"], f["slope"], f["intercept"], f["quantile_threshold"])
        )
    shared = locus.with_transformed(rows)
    measures = []
    for v, group in sorted(bands.items()):
        valid, count, keep = locus.band_rules(group, min_outlier_planes=min_outlier_planes)
        member = F.col(f"in__{v}")
        measures += [
            F.count_if(member).alias(f"n__{v}"),
            F.count_if(member & F.coalesce(count >= min_outlier_planes, F.lit(False))).alias(f"o__{v}"),
            F.count_if(member & keep).alias(f"k__{v}"),
        ]
    wide = shared.groupBy("positive").agg(*measures)
    return wide.select("positive", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(len(bands[v])).alias("planes"), F.col(f"n__{v}").alias("n_rows"),
                 F.col(f"o__{v}").alias("outliers"), F.col(f"k__{v}").alias("kept"))
        for v in sorted(bands)
    ])))


def pool_table(spark, root: str, contract: Sequence[str] = ("query_hash",)) -> StagedTable:
    """The tiles of a pool build; its registry holds status and contract of every tile."""
    return StagedTable(spark, root, ["tile_id"], "status string, " + ", ".join(f"{c} string" for c in contract))


def build_pool(
    landing_rows: DataFrame, plan: DataFrame, known: DataFrame, loci, schema: locus.MaskSchema, root: str,
    *, contract: Sequence[str] = ("query_hash",), dry_run: bool = False, max_tiles: int | None = None, confirm_full_build: bool = False,
) -> DataFrame:
    """One job over all pending tiles: plan, annotate, write, verify, publish.

    A tile is redone unless its registry row carries the same contract and its files hold the registered rows; finished tiles are
    known from file footers. New rows are written to a folder of this attempt and read again; only if they are exactly the planned
    rows, the tiles are published, all at once. Otherwise the former tiles stay what readers see. An unbounded build has to be
    confirmed; ``max_tiles`` takes the first pending tiles by name. Returns the registry with the tiles redone by this call.
    """
    spark, table = landing_rows.sparkSession, pool_table(landing_rows.sparkSession, root, contract)
    if not dry_run and max_tiles is None and not confirm_full_build:
        raise PermissionError("a build of all tiles must be confirmed; give max_tiles for a bounded one")
    if max_tiles is not None and max_tiles < 1:
        raise ValueError("max_tiles must be positive")
    pending = tiles.pending_tiles(plan, table.registry(), contract, table.measured())
    if max_tiles is not None:
        pending = pending.orderBy("tile_id").limit(max_tiles)
    pending = cut_lineage(pending)
    columns = ["status", "row_count", *contract, "tile_id"]
    if dry_run or pending.isEmpty():
        return table.registry().select(*columns).withColumn("redone", F.lit(False))
    labels = joins.label_map(known).withColumnRenamed("label", "known_source_exclusion")
    todo = landing_rows.join(pending.select("tile_id"), "tile_id", "left_semi")
    attempt = table.stage(
        todo.join(settle(labels), "source_id", "left"), then=lambda rows: locus.evaluate_union(rows, loci, schema),
        turns=turns_of(todo.select("tile_id").count()),
    )
    written = landing.tile_counts(table.staged(attempt))
    checked = settle(landing.write_check(todo.select("tile_id", "source_id"), written))
    wrong = [r["tile_id"] for r in checked.where("not write_ok").select("tile_id").collect()]  # a row per faulty tile
    if wrong:
        raise ValueError(f"files do not hold the planned rows of tiles {sorted(wrong)}")
    counts = checked.select("tile_id", F.col("n_rows").alias("row_count"))
    table.publish(attempt, pending.select("tile_id").join(plan.select("tile_id", *contract), "tile_id").join(counts, "tile_id", "left").select(
        "tile_id", F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"), F.lit("completed").alias("status"), *contract
    ))
    done = pending.select("tile_id", F.lit(True).alias("__new"))
    redone = table.registry().select(*columns).join(done, "tile_id", "left")
    return redone.withColumn("redone", F.col("__new").isNotNull()).select(*columns, "redone")


def finalise_pool(spark, plan: DataFrame, root: str, *, contract: Sequence[str] = ("query_hash",)) -> DataFrame:
    """The manifest of a build whose planned tiles are all completed and whole; any other build is refused.

    One row: tiles, rows, and an order-free digest of the registry.
    """
    table = pool_table(spark, root, contract)
    registry = cut_lineage(table.registry().select("tile_id", "status", "row_count", *contract))
    state = plan.select("tile_id").join(registry, "tile_id", "full_outer").join(table.measured(), "tile_id", "left")
    whole = (F.col("status") == "completed") & (F.coalesce("measured_rows", F.lit(0)) == F.col("row_count"))
    open_ = [r["tile_id"] for r in state.where(~F.coalesce(whole, F.lit(False))).select("tile_id").collect()]
    if open_:
        raise ValueError(f"tiles not completed: {sorted(open_)}")
    manifest = registry.agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("row_count").alias("n_rows"),
        F.sum(F.xxhash64(*registry.columns).cast("decimal(38,0)")).cast("string").alias("digest"),
    )
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def audit_policies(pool: DataFrame, loci, schema: locus.MaskSchema, feature_sets, root: str, *, region: str = "region") -> DataFrame:
    """Filter audit: judge all rows once, write the comparison, derive the tables from the files."""
    pool = cut_lineage(pool)
    repeated = pool.groupBy(region, "source_id").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("a source appears twice in one region")
    compared = locus.compare_policies(pool, loci, schema, feature_sets=feature_sets)
    path = f"{root}/comparison"
    compared.write.mode("overwrite").parquet(path)
    rows = pool.sparkSession.read.schema(compared.schema).parquet(path)
    bits = dict(schema.bits)
    tables = {
        "region_summary": audits.with_policy_ratios(audits.policy_counts(rows, [region])),
        "variant_summary": audits.variant_counts(rows, bits),
        "variant_by_region": audits.variant_counts(rows, bits, [region]),
        "variant_overlap": pairwise_overlap(rows, bits, mask="compatible_variant_mask"),
        "headline_metrics": audits.with_policy_ratios(audits.policy_counts(rows, [])),
    }
    store.replace_tables(tables, root)
    return stage_log(root, pool.sparkSession, {name: "audit" for name in ("comparison", *tables)})
