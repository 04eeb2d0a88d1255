"""Named result tables: replacement, evolving appends, run partitions and digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from raresift.functions.hashing import dataset_digest

# Column endings that always hold text.
TEXT_ENDINGS = ("_sha256", "_json", "_path")


def replace_tables(frames: Mapping[str, DataFrame], root: str) -> None:
    """Fully replace each named table; a frame without columns leaves a placeholder."""
    for name, df in frames.items():
        if not df.columns:
            df = df.sparkSession.createDataFrame([], "_empty_placeholder boolean")
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    kinds = [type(a), type(b)]
    if all(k in order for k in kinds):
        return order[max(order.index(k) for k in kinds)]()
    return a if a == b else T.StringType()


def append_by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name with evolution: new columns are added and types reconciled.

    A stored column that has no value yet takes the incoming type; numbers are
    widened (integers become doubles when fractions arrive); text endings stay text.
    """
    old_types, new_types = dict(zip(old.columns, [f.dataType for f in old.schema])), {f.name: f.dataType for f in new.schema}
    shared = [c for c in old.columns if c in new_types and old_types[c] != new_types[c]]
    filled = {}
    if shared:
        filled = old.agg(*[F.count(c).alias(c) for c in shared]).first().asDict()
    target: dict[str, T.DataType] = {}
    for c in [*old.columns, *[c for c in new.columns if c not in old_types]]:
        if c.endswith(TEXT_ENDINGS):
            target[c] = T.StringType()
        elif c in old_types and c in new_types:
            empty = c in filled and filled[c] == 0
            target[c] = new_types[c] if empty else _wider(old_types[c], new_types[c])
        else:
            target[c] = old_types.get(c) or new_types[c]

    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[
            F.col(c).try_cast(kind) if isinstance(kind, T.StringType) or c in df.columns else F.lit(None).cast(kind).alias(c)
            for c, kind in target.items()
            if c in df.columns
        ])

    return cast(old).unionByName(cast(new), allowMissingColumns=True).select(*target)


def run_exists(table: DataFrame, run_id: str) -> bool:
    return not table.where(F.col("run_id") == run_id).limit(1).isEmpty()


def register_run(df: DataFrame, path: str, run_id: str, *, replace: bool = False) -> None:
    """Write the rows of one run as its own partition; refuse an existing run unless replacing."""
    spark = df.sparkSession
    try:
        known = run_exists(spark.read.parquet(path), run_id)
    except Exception as error:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = False
    if known and not replace:
        raise ValueError(f"run exists already: {run_id}")
    (
        df.where(F.col("run_id") == run_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty frame of the fixed schema when it is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def compact_copy(frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], run_id: str) -> dict[str, DataFrame]:
    """Column subsets of some tables and the rows of one run of the others."""
    return {
        name: df.select(*columns[name]) if name in columns else df.where(F.col("run_id") == run_id)
        for name, df in frames.items()
    }


def digest(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table (compare within Spark only)."""
    return df.agg(*dataset_digest(df.columns))


def write_snapshot(df: DataFrame, root: str) -> str:
    """Content-addressed copy; an existing snapshot of the same content is kept."""
    row = digest(df).first()
    path = f"{root}/snapshot={row['n_rows']}-{row['digest'] & 0xFFFFFFFFFFFFFFFF:016x}"
    try:
        df.sparkSession.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.write.parquet(path)
    return path


def export_ranked(df: DataFrame, path: str, rank: str, limit: int) -> None:
    """Ranked CSV of the first ``limit`` rows (a bounded review list, hence one file)."""
    top = df.where(F.col(rank) <= limit).orderBy(rank)
    top.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_counts(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows and repeated ids per table."""
    out = None
    for name, df in frames.items():
        per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        one = per_id.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("repeated_ids")
        ).select(F.lit(name).alias("table_name"), "n_rows", "repeated_ids")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_rows(pages: DataFrame, version: Column) -> DataFrame:
    """Content hash, version and size of each fetched page."""
    return pages.select("page_id", "url", F.sha2("html", 256).alias("sha256"), version.alias("version"),
                        F.length("html").alias("n_chars"))
