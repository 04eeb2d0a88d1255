"""Connected components by alternating large and small stars: a union-find whose state is a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from raresift.session import cut_lineage, release


def _lowest(links: DataFrame) -> DataFrame:
    """The smallest partner of each node, written so that the join with a hub's many links can be split."""
    return cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")))


def _large_star(links: DataFrame) -> DataFrame:
    """The step's links, written; nothing else that it wrote stays."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = _lowest(both)
    low = lowest.withColumn("low", F.least("low", "node"))
    out = cut_lineage(both.where("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")))
    release(lowest)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """Links come with ``a > b``; the step's links are written as in ``_large_star``."""
    low = _lowest(links)
    moved = links.join(low, F.col("a") == F.col("node")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    out = cut_lineage(moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct())
    release(low)
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node that can be reached.

    ``links`` holds two long columns, in either direction, with or without repeats and self-links. Each round writes its
    links to the shared folder, so a lost executor costs the round at most, and deletes those of the round before. A round that changes nothing ends the search.
    """
    one, two = links.columns
    now = cut_lineage(
        links.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).where("a > b").distinct()
    )
    before = _state(now)
    for _ in range(rounds):
        large = _large_star(now)
        release(now)
        now = _small_star(large)
        release(large)
        after = _state(now)
        if after == before:
            # Every node now points at the root of its star.
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            found = cut_lineage(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
            release(now)
            return found
        before = after
    raise RuntimeError(f"components not settled after {rounds} rounds")
