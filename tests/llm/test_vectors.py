"""Nearest neighbours and exact products, against brute force."""

import numpy as np
import pytest

from raresift.llm import collision_ann, norm_topk

AWKWARD = [
    (0, [1.0, 0.0, 0.0]), (50, [0.5, 0.5, 0.0]), (100, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [float("inf"), 1.0, 0.0]),
    (6, [None, 1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (9, []), (10, [2.0, -1.0, 0.1]),
    (11, [1.0, 2.0]),
]


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def arrays(df):
    rows = df.select("vec_id", "embedding").toPandas()
    return rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)


def brute(ids, vectors, query, k):
    scores = (vectors * vectors[ids == query][0]).sum(axis=1)
    order = np.lexsort((ids, -scores))
    return [(ids[i], scores[i]) for i in order if ids[i] != query][:k]


def test_recall_against_brute_force(embeddings):
    ids, vectors = arrays(embeddings)
    found = collision_ann.nearest(embeddings).toPandas()
    hits = total = 0
    for query, rows in found.groupby("query_id"):
        want = {i for i, _ in brute(ids, vectors, query, 20)}
        assert sorted(rows["rank"]) == list(range(1, 21)) and len(set(rows["vec_id"])) == 20
        hits, total = hits + len(want & set(rows["vec_id"])), total + 20
        exact = vectors[ids == query][0] @ vectors[np.searchsorted(ids, rows["vec_id"])].T
        assert np.allclose(exact, rows["score"], atol=1e-12, rtol=0)
    assert total == 20 * (ids % 20 == 0).sum() and hits / total >= 0.95


def test_unequal_lengths_and_clusters_keep_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    vectors = centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)) * 0.4
    vectors *= rng.uniform(0.2, 3, size=(1500, 1))
    vectors[700:900] = vectors[700]  # many equal vectors: the smallest ids must win
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found, ids, hits = collision_ann.nearest(df).toPandas(), np.arange(1500), 0
    for query, rows in found.groupby("query_id"):
        hits += len({i for i, _ in brute(ids, vectors, query, 20)} & set(rows["vec_id"]))
    assert hits / len(found) >= 0.95


def test_exact_products(embeddings):
    ids, vectors = arrays(embeddings)
    whole = np.floor(256 * vectors).astype(np.int64)
    found = norm_topk.largest_products(embeddings).toPandas().sort_values(["query_id", "rank"])
    for query, rows in found.groupby("query_id"):
        assert list(zip(rows["vec_id"], rows["score"])) == brute(ids, whole, query, 5)
    assert len(found) == 5 * (ids % 50 == 0).sum()


def test_pruning_loses_no_tie():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, size=(3000, 6)).astype(float)
    ids = rng.permutation(3000)
    got = norm_topk.top_products(ids, vectors, ids[:40], vectors[:40], 5, head=2, chunk=100)
    for query in ids[:40]:
        mine = [(i, s) for q, i, s in zip(*got) if q == query]
        assert mine == brute(ids, vectors, query, 5)


@pytest.mark.parametrize("search,every", [(collision_ann.nearest, 20), (norm_topk.largest_products, 50)])
def test_awkward_vectors(spark, search, every):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in AWKWARD], "vec_id long, embedding array<double>, id int, vb string")
    rows = search(df).collect()
    mine = [(r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 0]
    zero = [(5, 3)] if every == 50 else []  # a zero vector has products, but no direction
    assert mine[:4] == [(1, 10), (2, 7), (3, 8), (4, 50)] and mine[4:] == zero
    assert {r.query_id for r in rows} <= {0, 50, 100} and all(r.vec_id not in (4, 5, 6, 9, 11, None) for r in rows)
    assert search(df.limit(0)).count() == 0
