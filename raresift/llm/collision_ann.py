"""Approximate nearest neighbours by collision counting with query-centred windows.

Every projection keeps its own sorted array. A query opens a window around its own value in each of them; virtual
rehashing widens all windows together; a vector that lies in enough windows at once is verified with the exact product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from raresift.llm.vector_blocks import best_of, search_blocks


class CollisionIndex:
    """Sorted projections of one block of vectors.

    Vectors get one more component that makes their lengths equal, so the largest inner product is the nearest neighbour.
    The projections are orthonormal directions, which collide more independently than free ones.
    """

    def __init__(self, vectors: np.ndarray, projections: int, seed: int) -> None:
        self.vectors = vectors
        squares = (vectors**2).sum(axis=1)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))])
        self.radius = np.sqrt(squares.max())
        dim = lifted.shape[1]
        basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        self.axes = basis[:, : min(projections, dim)]
        places = lifted @ self.axes
        order = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=0).T.copy()
        self.rank = np.empty(self.sorted.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        for line, found in zip(self.rank, order.T, strict=True):
            line[found] = np.arange(len(vectors))
        self.spread = places.std()

    def candidates(self, queries: np.ndarray, *, threshold: float, share: float, least: int, first: float, growth: float):
        """(query number, vector numbers): all vectors over the collision threshold once they are at least ``least + share * n``."""
        n, m = len(self.vectors), len(self.axes.T)
        lengths = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        centres = np.column_stack([queries / lengths * self.radius, np.zeros(len(queries))]) @ self.axes
        need, enough = int(np.ceil(threshold * m)), min(n, least + int(share * n))
        active, half, kind = np.arange(len(queries)), first * self.spread, self.rank.dtype
        if half == 0:
            half = self.radius
        while len(active):
            counts = np.zeros((len(active), n), np.uint8 if m < 256 else np.uint16)
            for axis in range(m):
                centre = centres[active, axis]
                low = np.searchsorted(self.sorted[axis], centre - half)
                width = np.searchsorted(self.sorted[axis], centre + half, side="right") - low
                counts += (self.rank[axis][None, :] - low.astype(kind)[:, None]) < width.astype(kind)[:, None]
            enclosed = counts >= need
            done = enclosed.sum(axis=1) >= enough
            for at in np.flatnonzero(done):
                yield active[at], np.flatnonzero(enclosed[at])
            active, half = active[~done], half * growth


def nearest(
    embeddings: DataFrame, *, queries_every: int = 20, k: int = 20, projections: int = 64, threshold: float = 0.8,
    share: float = 0.1, first: float = 0.9, growth: float = 1.15, seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: ``k`` vectors of large inner product for every row whose id is divisible by ``queries_every``.

    Windows start at ``first`` standard deviations and grow by ``growth`` until the vectors in ``threshold`` of all windows
    are ``8 * k`` plus ``share`` of the block; all of these are verified, so equal vectors are found together. Scores are
    products of the stored vectors in double precision; ties go to the smaller id. Vectors that are NULL, zero, or hold
    a NULL or non-finite component take no part; fewer candidates than ``k`` give fewer rows; an empty table gives none.
    """

    def search(ids, vectors, query_ids, queries):
        index, found = CollisionIndex(vectors, projections, seed), []
        for at in range(0, len(queries), 32):
            part = queries[at:at + 32]
            for number, near in index.candidates(
                part, threshold=threshold, share=share, least=8 * k, first=first, growth=growth
            ):
                own = query_ids[at + number]
                near = near[ids[near] != own]
                scores = (vectors[near] * part[number]).sum(axis=1)
                best = best_of(ids[near], scores, k)
                found.append((np.full(len(best), own), ids[near][best], scores[best]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])

    return search_blocks(embeddings, F.col("id") % queries_every == 0, search, k=k, score_type="double", nonzero=True)
