"""Reading landed tiles and writing acquisition tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Explicit schema of a landed tile; nothing is inferred.
LANDING = T.StructType([
    T.StructField("source_id", T.LongType(), False),
    T.StructField("ra", T.DoubleType()),
    T.StructField("dec", T.DoubleType()),
    T.StructField("G", T.DoubleType()),
    T.StructField("BP", T.DoubleType()),
    T.StructField("RP", T.DoubleType()),
    T.StructField("parallax", T.DoubleType()),
    T.StructField("parallax_over_error", T.DoubleType()),
])


def read_csv_tiles(spark: SparkSession, path: str, schema: T.StructType = LANDING) -> DataFrame:
    """Landed CSV files of any number of tiles, columns matched by header name."""
    by_name = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return by_name.select(*schema.names)


def write_tiles(df: DataFrame, path: str, *, by: str = "tile_id", compression: str = "zstd") -> None:
    """Replace exactly the tiles present in ``df``.

    Range partitioning on (tile, source hash) gives tasks of equal size: small
    tiles share a task and get one file each, a dense tile is cut over several.
    """
    spread = df.repartitionByRange(F.col(by), F.xxhash64("source_id"))
    (
        spread.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(by)
        .parquet(path)
    )


def stored_rows(spark: SparkSession, path: str, *, by: str = "tile_id") -> DataFrame:
    """Rows per tile; only file footers and folder names are read."""
    return spark.read.parquet(path).groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))


def written_counts(spark: SparkSession, path: str, *, by: str = "tile_id", only: Sequence[str] | None = None) -> DataFrame:
    """Re-read row and distinct-id counts per tile, distinct ids spread over (tile, id).

    ``only`` restricts the reading to the folders of these tiles.
    """
    rows = spark.read.parquet(path)
    if only is not None:
        rows = rows.where(F.col(by).isin(list(only)))
    return tile_counts(rows, by=by)


def tile_counts(rows: DataFrame, *, by: str = "tile_id") -> DataFrame:
    """Rows and distinct ids of every tile."""
    per_id = rows.groupBy(by, "source_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_sources"))


def write_check(planned: DataFrame, written: DataFrame, *, by: str = "tile_id") -> DataFrame:
    """Tiles whose files do not hold exactly the planned rows."""
    plan = planned.groupBy(by).agg(F.count(F.lit(1)).alias("planned_rows"))
    joined = plan.join(written, by, "full_outer")
    good = F.col("n_rows").eqNullSafe(F.col("planned_rows")) & F.col("n_sources").eqNullSafe(F.col("planned_rows"))
    return joined.withColumn("write_ok", good)


def pool_views(spark: SparkSession, path: str, tiles: DataFrame) -> dict[str, DataFrame]:
    """Logical views over one directory: all rows, the eligible subset, completed tiles."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    views = {
        "acquisition_sources": rows,
        "pool_sources": rows.where("passes_any_exact_variant and known_source_exclusion is null"),
        "effective_tiles": tiles.where("status = 'completed'"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def by_ids(archive: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """Archive rows of an id list. Spark broadcasts the list only if its size allows."""
    return archive.join(ids.select(key).distinct(), key, "left_semi")


def by_types(
    archive: DataFrame, types: Sequence[str], *, type_column: str, order: Sequence[str], row_limit: int | None = None
) -> DataFrame:
    """Distinct rows of the asked types, tagged by type; ``row_limit`` rows per type if given."""
    from raresift.operators.ranking import top_per_group

    found = archive.where(F.col(type_column).isin(list(types))).distinct().withColumn("query_type", F.col(type_column))
    if row_limit is None:
        return found
    ordered = [F.asc(c) for c in order]
    return top_per_group(found, by=["query_type"], order=ordered, limit=row_limit, rank="__n", salt_on=order[0]).drop("__n")
