"""Shards as leaves of a k-d tree over document metadata, cut at weighted medians that are found in the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from raresift.operators.ordered import global_rank, running_totals
from raresift.session import cut_lineage

_GROUP = ["text_crc32", "size", "chars", "lines"]
DIMENSIONS = {
    "log_size": lambda: F.log(F.col("size").cast("double")),
    "bytes_per_char": lambda: F.col("size") / (F.col("chars") + 1),
    "log_line": lambda: F.log(F.col("size") / F.col("lines")),
}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row (a unique number), size, text_crc32, chars, lines; a NULL text counts as an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.length(text).alias("chars"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"),
    )


def _split(units: DataFrame, leaves: dict[int, int], extent: dict[str, float]) -> DataFrame:
    """One level: every node with several leaves is cut along its widest dimension at the weighted median (or share)."""
    spread = [(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
    stats = {r.node: r for r in units.groupBy("node").agg(F.sum("weight").alias("weight"), *spread).collect()}  # a row per node
    value, limit = F.lit(None).cast("double"), F.lit(None).cast("double")
    for node, r in stats.items():
        widest = max(DIMENSIONS, key=lambda d: r[d] / extent[d] if extent[d] else 0.0)
        value = F.when(F.col("node") == node, F.col(widest)).otherwise(value)
        limit = F.when(F.col("node") == node, F.lit(r.weight * (leaves[node] // 2) / leaves[node])).otherwise(limit)
    order = [F.col(c) for c in ("value", *_GROUP, "chunk")]
    ranked = running_totals(units.withColumn("value", value), by=["node"], order=order, totals={"upto": F.col("weight")})
    right = F.col("upto") - F.col("weight") / 2 > limit
    half = reduce(lambda rest, n: F.when(F.col("node") == n, F.lit(leaves[n] // 2)).otherwise(rest), stats, F.lit(0))
    return ranked.withColumn("node", F.col("node") + F.when(right, half).otherwise(F.lit(0))).select(*units.columns)


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, unit_share: float = 0.02) -> DataFrame:
    """doc_id, row, size, text_crc32, shard for every row; give the number of shards or the bytes a leaf should reach.

    Equal texts have equal metadata and move as one unit, so they share a shard, unless together they are more than
    ``unit_share`` of a leaf: then the group is dealt into units of about that size, which is what keeps the shards even
    when one text makes up a third of all rows. Every cut leaves both sides within half a unit of their share. Rows with
    NULL ids and repeated rows are rows like others; an empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(measured(docs))
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = shards or max(1, round(total / target_bytes))
    quantum = max(1, int(unit_share * total / count))
    groups = rows.groupBy(*_GROUP).agg(F.sum("size").alias("weight"))
    # At most count / unit_share groups can weigh more than one quantum, so this side has a proven bound.
    heavy = groups.where(F.col("weight") > quantum).select(*_GROUP, F.ceil(F.col("weight") / quantum).alias("chunks"))
    rows = rows.join(F.broadcast(heavy), _GROUP, "left").withColumn(
        "chunk", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("chunks"))).cast("int")
    ).drop("chunks")
    units = rows.groupBy(*_GROUP, "chunk").agg(F.sum("size").alias("weight")).withColumns(
        {name: made() for name, made in DIMENSIONS.items()} | {"node": F.lit(0)}
    )
    units = cut_lineage(units)
    whole = units.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first().asDict()
    leaves, done = {0: count}, []
    while any(n > 1 for n in leaves.values()):
        grown = F.col("node").isin([node for node, n in leaves.items() if n > 1])
        done.append(units.where(~grown))
        units = cut_lineage(_split(units.where(grown), leaves, {d: x or 0.0 for d, x in whole.items()}))
        leaves = {k: v for node, n in leaves.items() if n > 1 for k, v in ((node, n // 2), (node + n // 2, n - n // 2))}
    done.append(units)
    placed = reduce(DataFrame.unionByName, done).select(*_GROUP, "chunk", F.col("node").alias("shard"))
    return rows.join(cut_lineage(placed), [*_GROUP, "chunk"]).select("doc_id", "row", "size", "text_crc32", "shard")


def shard_report(docs: DataFrame, *, shards: int = 16) -> DataFrame:
    """The shards with gapless slots by doc_id, under the law that their bytes are near equal."""
    ranked = global_rank(kd_shards(docs, shards=shards), by=["shard"], order=[F.col("doc_id"), F.col("row")], name="place")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
