import numpy as np
import pytest
from pyspark.sql import functions as F

from sigscreen.operators import iterate as T
from sigscreen.operators.graph import pair_counts
from sigscreen.runtime import cut_lineage, shared_folder


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(4)
    order = list(rng.permutation(120))
    edges = [(int(a), int(b)) for a, b in zip(order, order[1:])]            # a long chain
    edges += [(500, 500 + i) for i in range(1, 40)]                          # a star
    edges += [(900, 900), (901, 902)]
    edges += [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 60, (40, 2))]
    got = {r["id"]: r["component"] for r in T.connected_components(
        spark.createDataFrame(edges, "s long, d long"), "s", "d").collect()}
    assert got == _components(edges)


def test_chain_needs_few_rounds(spark, monkeypatch):
    written = []

    def counted(df):
        written.append(df.columns)
        return cut_lineage(df)

    monkeypatch.setattr(T, "cut_lineage", counted)
    edges = [(i, i + 1) for i in range(300)]
    got = T.connected_components(spark.createDataFrame(edges, "s long, d long"), "s", "d")
    assert got.where("component <> 0").count() == 0
    rounds = sum("_old" in columns for columns in written)          # one such table a round
    assert 1 < rounds <= 12


def test_pagerank_against_dense_iteration(spark):
    edges = [(0, 1), (0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (4, 5)]      # 5 has no out-edge
    n, rank = 6, np.full(6, 1 / 6)
    w = np.zeros((n, n))
    for a, b in edges:
        w[a, b] += 1
    for _ in range(8):
        out = w.sum(1)
        flow = np.array([sum(rank[i] * w[i, j] / out[i] for i in range(n) if out[i])
                         for j in range(n)])
        rank = 0.15 / n + 0.85 * (flow + rank[out == 0].sum() / n)
    got = {r["id"]: r["pagerank"] for r in T.pagerank(
        spark.createDataFrame(edges, "s long, d long"), "s", "d", 8).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(rank)
    assert sum(got.values()) == pytest.approx(1)


def test_label_propagation_hides_the_own_fold(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "s string, r string")
    pairs = pair_counts(edges, "s", "r")

    def run(label_of_a):
        known = spark.createDataFrame([("a", label_of_a, 0), ("b", None, -1), ("c", None, -1),
                                       ("d", "z", 1)], "id string, lab string, fold int")
        return {r["id"]: r["lp_label"] for r in T.label_propagation(
            pairs, known, "id", "lab", 3).collect()}

    first, second = run("x"), run("y")
    assert first["a"] == second["a"] == "z"
    assert first["b"] == "x" and second["b"] == "y"
    assert first["c"] == "x"            # b says x and d says z: the smaller one


def test_walks_follow_edges_and_repeat(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)],
                                  "s long, r long")
    pairs = pair_counts(edges, "s", "r")
    near = {(r["a"], r["b"]) for r in pairs.collect()}
    first = sorted(map(tuple, T.random_walks(pairs, 5, 2).collect()))
    assert len(first) == 60 and first == sorted(map(tuple, T.random_walks(pairs, 5, 2).collect()))
    for start, _, path in first:
        assert path[0] == start and len(path) == 6
        assert all(step in near for step in zip(path, path[1:]))


def test_embeddings_of_walks(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "s long, r long")
    walks = T.random_walks(pair_counts(edges, "s", "r"), 4, 3)
    for frame in (T.walk_embeddings(walks, 6), T.walk_embeddings(walks, 6, max_nodes=3)):
        rows = frame.collect()
        assert {r["id"] for r in rows} == {str(i) for i in range(12)}
        assert all(len(r["embedding"]) == 6 for r in rows)


def test_projected_embedding_counts_the_window(spark):
    walks = spark.createDataFrame([("a", 1, ["a", "b", "c", "d"])],
                                  "id string, walk int, path array<string>")
    got = {r["id"]: r["embedding"] for r in T.projected_embeddings(walks, 4, window=1).collect()}
    sign = {r["id"]: r["embedding"] for r in T.projected_embeddings(spark.createDataFrame(
        [(p, 1, [p, q]) for p, q in ("ab", "bc", "cd", "dc")],
        "id string, walk int, path array<string>"), 4, window=1).collect()}
    assert got["a"] == sign["a"]           # a sees only b in both
    assert all(abs(v) <= 1 for v in got["b"])


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert folder.split(":")[-1] in df.inputFiles()[0] and df.count() == 5


def test_walk_embeddings_are_one_operator_at_every_size(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "s long, r long")
    walks = T.random_walks(pair_counts(edges, "s", "r"), 4, 3)
    want = sorted(map(tuple, T.projected_embeddings(walks, 6).collect()))
    for limit in (3, 2_000_000):
        assert sorted(map(tuple, T.walk_embeddings(walks, 6, max_nodes=limit).collect())) == want
