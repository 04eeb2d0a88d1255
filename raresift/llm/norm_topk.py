"""Exact top-k inner products over vectors in order of length, pruned by Cauchy-Schwarz bounds on rotated partial sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from raresift.llm.vector_blocks import best_of, search_blocks


def top_products(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, *, head: int = 16, chunk: int = 512
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest integer products of each query with vectors of another id.

    The rotation to the vectors' singular directions puts most of a product into its first ``head`` terms. What the other
    terms can add is at most the product of the two remaining lengths, and whole chunks end once length alone rules them out.
    """
    whole, asked = vectors.astype(np.int64), queries.astype(np.int64)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, whole, lengths = ids[order], whole[order], lengths[order]
    _, directions = np.linalg.eigh(vectors.T @ vectors)
    directions = directions[:, ::-1][:, :head]
    front, query_front = whole @ directions, queries @ directions
    rest = np.sqrt(np.maximum(lengths**2 - (front**2).sum(axis=1), 0))
    query_lengths = np.sqrt((queries**2).sum(axis=1))
    query_rest = np.sqrt(np.maximum(query_lengths**2 - (query_front**2).sum(axis=1), 0))
    # Products are integers, so anything within half a unit, plus rounding, of the k-th best is still verified.
    slack = 0.5 + 1e-9 * query_lengths * lengths.max(initial=0)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
    least = np.full(len(queries), -np.inf)
    for at in range(0, len(ids), chunk):
        part = slice(at, at + chunk)
        active = np.flatnonzero(query_lengths * lengths[at] >= least - slack)
        if not len(active):
            break
        bound = query_front[active] @ front[part].T + np.outer(query_rest[active], rest[part])
        hopeful = bound >= (least - slack)[active, None]
        for row in np.flatnonzero(hopeful.any(axis=1)):
            q = active[row]
            near = at + np.flatnonzero(hopeful[row])
            near = near[ids[near] != query_ids[q]]
            scores = (whole[near] * asked[q]).sum(axis=1)
            keep = scores >= least[q]
            found = np.concatenate([best[q][0], ids[near][keep]]), np.concatenate([best[q][1], scores[keep]])
            top = best_of(*found, k)
            best[q] = found[0][top], found[1][top]
            if len(top) == k:
                least[q] = best[q][1][-1]
    return (
        np.repeat(query_ids, [len(b[0]) for b in best]), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best]),
    )


def largest_products(embeddings: DataFrame, *, queries_every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest products of ``floor(scale * x)`` vectors, exactly.

    Queries are the rows whose id is divisible by ``queries_every``; candidates are all rows with another id; ties go to the
    smaller id. Vectors that are NULL or hold a NULL or non-finite component take no part. Scores must fit a long.
    """

    def search(ids, vectors, query_ids, queries):
        return top_products(ids, np.floor(scale * vectors), query_ids, np.floor(scale * queries), k)

    return search_blocks(embeddings, F.col("id") % queries_every == 0, search, k=k, score_type="long", nonzero=False)


ORACLE = """
WITH c AS (
    SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings
), bad AS (
    SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR isnan(x) OR isinf(x)
), v AS (
    SELECT vec_id, i, floor(256 * x)::BIGINT AS x FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, v.vec_id
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
