"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def local_session(cores: str = "*", app: str = "raresift", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local master, where driver and executors are one process, falls back
    to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="raresift-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write ``df`` (and ``more`` rows of the same columns) once to the shared folder and continue from the files.

    Used where two consumers must see the very same partition assignment
    (range-partition ids), which a recomputation after a lost executor would
    not guarantee. Parquet keeps column pruning and filter pushdown alive.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/raresift-{uuid.uuid4().hex}"
    _written.append(path)
    for rows in (df, *more):
        rows.write.mode("append").parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    _path_of[cut] = path
    return cut


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of each query that has ended; else they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


#: Rows that are shuffled at a time where a table is written in turns, and the most turns, as each reads the input again.
ROWS_A_TURN, MOST_TURNS = 1_000_000, 8


def turns_of(rows: int) -> int:
    return min(MOST_TURNS, max(1, -(-rows // ROWS_A_TURN)))


def part(df: DataFrame, by: str, turn: int, turns: int) -> DataFrame:
    """The rows of one of ``turns`` parts by a hash of ``by``."""
    return df.where(F.pmod(F.xxhash64(by, F.lit(turns)), F.lit(turns)) == turn) if turns > 1 else df


def settle(df: DataFrame, *, by: str = "", turns: int = 1) -> DataFrame:
    """``cut_lineage``, part by part; the shuffle files of a part are deleted before the next one is made."""
    with shuffles_deleted(df.sparkSession):
        return cut_lineage(*[part(df, by, turn, turns) for turn in range(turns)])


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut_lineage`` returned; call it when nothing reads them again."""
    for df in frames:
        path, sc = _path_of.pop(df), df.sparkSession.sparkContext
        _written.remove(path)
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def release_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call it when no frame needs them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
