"""Hard negatives on ties, repeated ids, odd vectors and planted clusters, against all products."""

import numpy as np
import pytest

from sigscreen.llm import corpus, negatives


def _plain(rows, anchors, positives=5, wanted=3):
    """rows: id -> (label, whole numbers)."""
    out = []
    for a in anchors:
        label, q = rows[a]
        scores = [(-sum(x * y for x, y in zip(v, q)), i, own == label) for i, (own, v) in rows.items() if i != a and len(v) == len(q)]
        scores.sort()
        for s, p, _ in [t for t in scores if t[2]][:positives]:
            fit = [(t, i) for t, i, same in scores if not same and 50 * -s <= 100 * -t <= 95 * -s][:wanted]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def _whole(v, scale=256):
    return [int(np.floor(scale * float(x))) for x in v]


@pytest.mark.parametrize("shard", [7, 8192])
def test_odd_rows_against_all_products(spark, monkeypatch, shard):
    corpus.reachable(spark)
    monkeypatch.setattr(negatives, "SHARD", shard)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)], int(i % 3)) for i in range(120)]
    rows += [(200 + i, rows[i][1], 1) for i in range(20)]                              # ties
    rows += [(300, [0.0] * 4, 0), (301, None, 0), (302, [1.0, None, 0.0, 0.0], 0), (303, [1.0, float("nan"), 0.0, 0.0], 1),
             (304, [1.0, float("inf"), 0.0, 0.0], 1), (305, rows[0][1], None), (None, rows[0][1], 0), (306, [], 0), (350, [], 1), (310, [3.0, 4.0], 0),
             (311, [1.0, 2.0], 0), (312, [1.0, 1.5], 1), (300, [0.0] * 4, 0), (0, [9.0] * 4, 2)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows],
                                  "vec_id long, embedding array<double>, label int, dim int, score long").repartition(4)
    kept = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
                               and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], _whole(r[1]))):
        kept.setdefault(i, (label, _whole(v)))
    anchors = [i for i in kept if i % 10 == 0]
    got = sorted(map(tuple, negatives.hard_negatives(frame, frame.where("vec_id % 10 = 0")).collect()))
    assert got == _plain(kept, anchors) and len(got) > 50
    assert negatives.hard_negatives(frame.limit(0), frame).count() == negatives.hard_negatives(frame, frame.limit(0)).count() == 0


def _clusters(rng, n, dim=16):
    centers = rng.normal(size=(20, dim))
    return np.floor(256 * (centers[rng.integers(20, size=n)] + 0.05 * rng.normal(size=(n, dim)))).astype(np.int32)


def test_the_tree_covers_and_passes_over_nodes():
    rng = np.random.default_rng(5)
    vectors, labels = _clusters(rng, 3000), rng.integers(0, 4, 3000)
    tree = negatives.build(np.arange(3000), labels, vectors)
    assert sorted(tree["ids"]) == list(range(3000))
    leaves = tree["first"] == tree["last"]
    search = negatives.Search(tree, {"ids": np.arange(50), "labels": labels[:50], "vectors": vectors[:50]})
    for node in range(len(tree["lo"])):
        rows = tree["vectors"][tree["lo"][node]:tree["hi"][node]]
        score = vectors[:50].astype(float) @ rows.T.astype(float)
        assert (score <= search.above[:, node, None]).all() and (score >= search.below[:, node, None]).all()
    for a in range(50):
        score = vectors.astype(np.int64) @ vectors[a].astype(np.int64)
        order = [int(i) for i in np.lexsort((np.arange(3000), -score)) if labels[i] == labels[a] and i != a][:5]
        assert [i for _, i in search.run(a, True, [[negatives.LEAST, negatives.MOST, negatives.LEAST]], 5)[0]] == order
    assert search.leaves < 50 * leaves.sum() / 3


def test_products_beyond_a_long_are_cut():
    big = np.array([[2**62, 2**62], [3, 4]], np.int64)
    assert negatives.products(big, np.array([4, 4])).tolist() == [2**63 - 1, 28]
    assert negatives.products(big, np.array([-4, -4])).tolist() == [-2**63, -28]
    assert negatives.products(np.array([[2**31, 2**31]]), np.array([2**31 - 1, 1])).tolist() == [2**31 * 2**31]
