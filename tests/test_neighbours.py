"""The nearest-neighbour join and the vector index against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from shelf.operators import neighbours, vector


def table(spark, vectors, name="chunk_id", parts=3):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors], f"{name} long, embedding array<float>").repartition(parts)


def clustered(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, width)) * 5
    return [(k, (middles[k % 12] + rng.normal(size=width) * 0.3).astype(np.float32)) for k in range(n)]


def brute(query, rows, k):
    q = np.asarray(query, np.float32).astype(np.float64)
    all_ = sorted((float(np.sqrt(((np.asarray(v, np.float32).astype(np.float64) - q) ** 2).sum())), i) for i, v in rows if v is not None and len(v) == len(q))
    return all_[:k]


@pytest.mark.parametrize("most", [700, 1 << 20])
def test_join_equals_brute_force_in_blocks_of_any_size(spark, most):
    rows = clustered(500) + [(900, None), (901, [1.0] * 3), (902, [1.0] * 3)] + [(1000 + k, np.ones(16)) for k in range(40)]
    asked = [(k, v) for k, v in rows if k % 50 == 0] + [(77, [1.0] * 3), (78, None), (79, [])]
    got: dict[int, list] = {}
    for r in neighbours.nearest(table(spark, asked, "query_id"), table(spark, rows), 7, most).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_distance, r.chunk_id))
    want = {q: b for q, v in asked if v is not None and (b := brute(v, rows, 7))}
    assert got.keys() == want.keys()
    for q, b in want.items():
        assert [(n, i) for n, _, i in sorted(got[q])] == [(n, i) for n, (_, i) in enumerate(b, 1)]
        assert [d for _, d, _ in sorted(got[q])] == pytest.approx([d for d, _ in b], abs=1e-12)
    assert neighbours.nearest(table(spark, asked, "query_id"), table(spark, rows).limit(0), 7).collect() == []


def test_matrix_product_never_decides(spark):
    """Vectors far from the origin, whose differences a product in one precision would lose."""
    base = np.full(8, 1e6)
    ids, vectors = np.arange(50), base + np.arange(50)[:, None] * 1e-4
    rows, found, far = neighbours.nearest_of(base[None] + 1e-4 * 20.3, ids, vectors, 5)
    assert rows.tolist() == [0] * 5 and found.tolist() == [20, 21, 19, 22, 18] and np.all(np.diff(far) > 0)


def test_index_equals_brute_force_and_reads_little(spark, tmp_path):
    rows = clustered(3_000) + [(9_000, None)]
    index = neighbours.VectorIndex.build(table(spark, rows), str(tmp_path), 24)
    assert index.total == 3_000
    shares = []
    for k, (_, v) in enumerate(rows[:3_000:400]):
        done = index.search(list(map(float, v)), 10)
        assert [r.chunk_id for r in done.hits.collect()] == [i for _, i in brute(v, rows, 10)]
        shares.append(done.scanned / done.total)
    assert max(shares) < 0.25  # of vectors in twelve heaps
    far = index.search([50.0] * 16, 3)
    assert [r.chunk_id for r in far.hits.collect()] == [i for _, i in brute([50.0] * 16, rows, 3)]
    hits = vector.vector_search(table(spark, rows), [float(x) for x in rows[5][1]], 10)
    assert [tuple(r) for r in hits.collect()] == [tuple(r) for r in index.search([float(x) for x in rows[5][1]], 10).hits.collect()]
    again = neighbours.VectorIndex(spark, str(tmp_path))  # opened from its files
    assert [r.chunk_id for r in again.search([50.0] * 16, 3).hits.collect()] == [r.chunk_id for r in far.hits.collect()]


def test_index_of_hardly_prunable_equal_few_and_no_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    flat = [(k, v / np.linalg.norm(v)) for k, v in enumerate(rng.normal(size=(400, 32)))]
    index = neighbours.VectorIndex.build(table(spark, flat), f"{tmp_path}/a")
    for q in (flat[3][1], -flat[9][1]):
        assert [r.chunk_id for r in index.search([float(x) for x in q], 20).hits.collect()] == [i for _, i in brute(q, flat, 20)]
    same = neighbours.VectorIndex.build(table(spark, [(k, [1.0, 2.0]) for k in range(100)]), f"{tmp_path}/b")
    assert [r.chunk_id for r in same.search([0.0, 0.0], 5).hits.collect()] == [0, 1, 2, 3, 4] and len(same.clusters) == 1
    few = neighbours.VectorIndex.build(table(spark, [(1, [1.0]), (2, [5.0])]), f"{tmp_path}/c")
    assert [r.chunk_id for r in few.search([4.0], 9).hits.collect()] == [2, 1] and few.search([1.0, 2.0], 3).hits.collect() == []
    none = neighbours.VectorIndex.build(table(spark, [(1, [1.0])]).limit(0), f"{tmp_path}/d")
    assert none.search([1.0], 3).hits.collect() == [] and none.total == 0
    with pytest.raises(ValueError):
        neighbours.VectorIndex.build(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]), f"{tmp_path}/e")


def test_a_search_prunes_folders_and_rings(spark, tmp_path):
    index = neighbours.VectorIndex.build(table(spark, clustered(600)), str(tmp_path), 12)
    from pyspark.sql import functions as F

    plan = index._vectors(spark, index.path).where(F.col("cluster").isin([1, 2]) & F.col("far").between(0.1, 0.4))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan and "GreaterThanOrEqual(far" in plan
