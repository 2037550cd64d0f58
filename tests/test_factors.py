"""Factors of a walk matrix, against a dense decomposition, and vectors that tell planted groups apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigscreen.operators import factors as X
from sigscreen.operators import iterate as T
from sigscreen.operators import joins
from sigscreen.operators.graph import pair_counts


def _entries(spark, matrix):
    n = len(matrix)
    rows = [(f"n{i:03d}", f"n{j:03d}", float(matrix[i, j])) for i in range(n) for j in range(n) if matrix[i, j]]
    return spark.createDataFrame(rows, "i string, j string, v double")


@pytest.mark.parametrize("small", [joins.SMALL_ROWS, 10])
def test_leading_factors_are_those_of_a_dense_decomposition(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL_ROWS", small)
    rng = np.random.default_rng(6)
    n = 60
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    want = np.concatenate([[9.0, -7.0, 5.0], 0.2 * rng.normal(size=n - 3)])
    matrix = (q * want) @ q.T
    found, values = X.factorise(_entries(spark, matrix), 3, 6, 4)
    assert values == pytest.approx([9.0, -7.0, 5.0], abs=1e-6)
    u = {r["i"]: r["u"] for r in found.collect()}
    u = np.array([u[f"n{i:03d}"] for i in range(n)])
    assert np.abs(u.T @ u - np.eye(3)).max() < 1e-9 and (u.sum(axis=0) >= 0).all()
    assert np.abs(np.abs((u * q[:, :3]).sum(axis=0)) - 1).max() < 1e-5
    facts = X.rebuilt(_entries(spark, matrix), found, values).first()
    left = matrix - (u * values) @ u.T
    assert facts["norm"] == pytest.approx((matrix**2).sum()) and facts["error"] == pytest.approx((left**2).sum(), abs=1e-6)


def test_a_matrix_of_lower_rank_than_asked_for(spark):
    v = np.arange(1.0, 13.0)
    found, values = X.factorise(_entries(spark, np.outer(v, v)), 3, 2, 2)
    assert values[0] == pytest.approx((v**2).sum()) and np.abs(values[1:]).max() < 1e-6
    assert X.rebuilt(_entries(spark, np.outer(v, v)), found, values).first()["error"] == pytest.approx(0, abs=1e-5)


def test_pmi_of_counts(spark):
    counts = spark.createDataFrame([("a", "b", 3), ("b", "a", 3), ("a", "c", 1), ("c", "a", 1)], "i string, j string, n long")
    got = {(r["i"], r["j"]): r["v"] for r in X.shifted_pmi(counts, 1.2).collect()}
    assert got == pytest.approx({k: np.log(n * 8 / (s * t)) - np.log(1.2) for k, n, s, t in (
        (("a", "b"), 3, 4, 3), (("b", "a"), 3, 3, 4), (("a", "c"), 1, 4, 1), (("c", "a"), 1, 1, 4))})
    assert X.shifted_pmi(counts, 100.0).count() == 0


def test_nodes_of_one_group_lie_near_each_other(spark):
    edges = [(100 * g + a, 100 * g + b) for g in range(2) for a in range(12) for b in range(12) if a < b] + [(0, 100)]
    walks = T.random_walks(pair_counts(spark.createDataFrame(edges, "s long, r long"), "s", "r"), 6, 6)
    rows = {int(r["id"]): np.array(r["embedding"]) for r in X.learned_embeddings(walks, 4).collect()}
    assert len(rows) == 24
    def near(a, b):
        return rows[a] @ rows[b] / np.linalg.norm(rows[a]) / np.linalg.norm(rows[b])
    inside = np.mean([near(a, b) for g in (0, 100) for a in range(g, g + 12) for b in range(g, g + 12) if a != b])
    across = np.mean([near(a, b) for a in range(12) for b in range(100, 112)])
    assert inside > across + 0.3
    again = {int(r["id"]): np.array(r["embedding"]) for r in X.learned_embeddings(walks.repartition(5), 4).collect()}
    assert all(np.abs(again[i] - rows[i]).max() < 1e-6 for i in rows)
    assert X.cooccurrences(walks.where(F.lit(False))).count() == 0
