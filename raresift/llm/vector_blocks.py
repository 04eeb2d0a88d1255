"""Searches of a query set against all vectors, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: vectors (ids, rows), queries (ids, rows) -> query ids, vector ids, scores
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: str, *, nonzero: bool) -> Column:
    """True for a vector that is not NULL and holds neither NULL nor a non-finite component."""
    whole = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return whole & F.exists(vector, lambda x: x != 0) if nonzero else whole


def search_blocks(
    table: DataFrame, is_query: Column, search: Search, *, k: int, score_type: str, nonzero: bool,
    id_col: str = "vec_id", vector_col: str = "embedding", per_block: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of what ``search`` returns for each pair of blocks.

    Vectors and queries are dealt to blocks of about ``per_block`` rows by a hash of id and vector, so a vector that a third
    of all rows share spreads over all blocks. Every query block meets every vector block of its dimension once; a task
    holds one such pair. Rows without an id or without a usable vector take no part; rows equal in id and vector count once,
    and an id with several vectors counts with its best score.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(
        F.col("id").isNotNull() & usable("vector", nonzero=nonzero)
    ).dropDuplicates(["id", "vector"]).withColumn("dim", F.size("vector"))
    queries = rows.where(is_query)
    rows_blocks = max(1, -(-table.count() // per_block))
    query_blocks = max(1, -(-table.select(F.col(id_col).alias("id")).where(is_query).count() // per_block))
    block = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", block(rows_blocks).alias("vb"), each(query_blocks).alias("qb"))
    right = queries.select("*", block(query_blocks).alias("qb"), each(rows_blocks).alias("vb"))

    def run(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = ([], [], [])
        if len(vectors) and len(asked):
            vectors, asked = vectors.sort_values("id"), asked.sort_values("id")
            found = search(
                vectors["id"].to_numpy(), np.stack(vectors["vector"].to_numpy()).astype(float),
                asked["id"].to_numpy(), np.stack(asked["vector"].to_numpy()).astype(float),
            )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["vb", "qb", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        run, f"query_id long, vec_id long, score {score_type}"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best distinct ids: highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order[: 4 * k]], return_index=True)[1])
    if len(first) < k < len(order):  # an id may occur with several vectors
        first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first[:k]]
