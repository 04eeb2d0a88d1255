"""Tables whose units (tiles, or models by tiles) are replaced only after their new files were checked.

An attempt writes to a folder of its own. Publishing it is one small write: a new version of the registry, which names the attempt
that each unit's rows are read from. Until then, and if a check fails or the job dies, readers see the former rows. A version counts
once all of its entries can be read, so a half-written one is passed over, and two writers cannot publish one version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.session import cut_lineage, part, shuffles_deleted


class StagedTable:
    """Rows and registry under ``root``; ``keys`` name a unit, ``payload`` (a DDL text) what the registry keeps of it."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], payload: str):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        names = ", ".join(f"{k} string" for k in self.keys)
        self._schema = f"{names}, unit string, attempt string, row_count long, {payload}, entries long"

    def _unit(self) -> F.Column:
        return F.concat(F.lit("u"), F.lower(F.hex(F.xxhash64(*self.keys))))

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{self._schema}, version long").parquet(f"{self.root}/registry")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def version(self) -> int:
        """The latest whole version, 0 before the first."""
        found = self._versions()
        if found is None:
            return 0
        whole = found.groupBy("version").agg((F.count(F.lit(1)) == F.max("entries")).alias("whole")).where("whole")
        return whole.agg(F.max("version")).first()[0] or 0

    def registry(self) -> DataFrame:
        """The units of the latest version: keys, unit, attempt, row_count and payload."""
        latest, found = self.version(), self._versions()
        if not latest:
            return self.spark.createDataFrame([], self._schema).drop("entries")
        return found.where(F.col("version") == latest).drop("version", "entries")

    def rows(self) -> DataFrame:
        """The rows of the latest version; only the folders of its attempts and units are read."""
        kept = self.registry().where("row_count > 0").select("attempt", "unit")
        return self.spark.read.parquet(f"{self.root}/data").join(kept, ["attempt", "unit"], "left_semi").drop("attempt", "unit")

    def measured(self) -> DataFrame:
        """keys, measured_rows: rows of the latest version's units as the file footers count them; units without rows have 0."""
        units = self.registry().select(*self.keys, "unit", "attempt")
        try:
            held = self.spark.read.parquet(f"{self.root}/data").groupBy("attempt", "unit").agg(F.count(F.lit(1)).alias("n"))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            return units.select(*self.keys, F.lit(0).cast("long").alias("measured_rows"))
        return units.join(held, ["attempt", "unit"], "left").select(*self.keys, F.coalesce("n", F.lit(0)).alias("measured_rows"))

    def stage(
        self, rows: DataFrame, *, spread: str = "source_id", compression: str = "zstd", then: Callable[[DataFrame], DataFrame] | None = None,
        turns: int = 1,
    ) -> str:
        """Write the rows of some units to a new attempt; range partitioning cuts a dense unit over several tasks.

        ``then`` adds columns to the rows once they are dealt: what is dealt is computed twice, the first time for the ranges.
        The rows are dealt in ``turns`` parts by a hash of ``spread``, and the shuffle files of a part are deleted before the next one.
        """
        attempt = f"a{uuid.uuid4().hex}"
        with shuffles_deleted(self.spark):
            for turn in range(turns):
                dealt = part(rows, spread, turn, turns).withColumn("unit", self._unit()).repartitionByRange(F.col("unit"), F.xxhash64(spread))
                (then(dealt) if then else dealt).write.mode("append").partitionBy("unit").option("compression", compression).parquet(
                    f"{self.root}/data/attempt={attempt}"
                )
        return attempt

    def staged(self, attempt: str) -> DataFrame:
        """The rows of an attempt as its files hold them."""
        return self.spark.read.parquet(f"{self.root}/data/attempt={attempt}").drop("unit")

    def publish(self, attempt: str, entries: DataFrame) -> int:
        """Make the attempt's units (keys, row_count, payload) the current ones; all other units stay as they are."""
        latest = self.version()
        new = entries.withColumns({"unit": self._unit(), "attempt": F.lit(attempt)})
        names = [f.name for f in self.registry().schema.fields]
        kept = self.registry().join(new.select("unit"), "unit", "left_anti")
        both = cut_lineage(kept.select(*names).unionByName(new.select(*names)))
        if not both.groupBy("unit").count().where("count > 1").isEmpty():
            raise ValueError("a unit is published twice")
        target = f"{self.root}/registry/version={latest + 1}"
        both.withColumn("entries", F.lit(both.count())).coalesce(1).write.mode("errorifexists").parquet(target)
        return latest + 1

    def clean(self) -> int:
        """Delete attempts that no unit of the latest version reads; returns their number. No writer may be at work."""
        used = {r["attempt"] for r in self.registry().select("attempt").distinct().collect()}  # an attempt a call
        jvm = self.spark.sparkContext._jvm
        data = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        files = data.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(data):
            return 0
        removed = 0
        for found in files.listStatus(data):
            name = found.getPath().getName()
            if name.startswith("attempt=") and name.removeprefix("attempt=") not in used:
                removed += bool(files.delete(found.getPath(), True))
        return removed
