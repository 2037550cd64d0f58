"""The nearest-neighbor estimate under many labelings at once."""

import os
import subprocess
import sys

import brute
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sigscreen.operators import information as I
from sigscreen.operators import nearest as N
from sigscreen.operators import ordering as O


@pytest.fixture(params=[25, 100_000])
def bucket_rows(request, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", request.param)
    monkeypatch.setattr(O, "SKETCH_SHARE", 1)


def _rows(n=200, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.37, 0.03]).astype(object)
    y[0], y[1], y[2] = "single", "pair", "pair"
    x = rng.normal(0, 1, n)
    return [(i, str(c), float(v), float(round(v))) for i, (c, v) in enumerate(zip(y, x))]


def _plain(rows):
    """MI by search over (id, y, x), without classes of one row."""
    y, x = np.array([r[1] for r in rows], object), np.array([r[2] for r in rows])
    known = np.array([c is not None and (y == c).sum() > 1 for c in y])
    return brute.mi_knn(x[known], y[known])


def test_null_of_numbers_against_search(spark, bucket_rows):
    df = spark.createDataFrame(_rows(), "id long, y string, x double, z double")
    got = {(r["k"], r["feature"]): r["mi"] for r in I.permutation_mi(df, "id", "y", ["x", "z"], [], 4).collect()}
    assert len(got) == 8
    labels = I.permuted_labels(df.select("id", "y"), "id", "y", 4).collect()
    for feature in ("x", "z"):
        noisy = {r["id"]: r["x"] for r in I._jittered(I.numeric_cells(df, "id", "y", [feature]), []).collect()}
        for k in range(1, 5):
            assert got[k, feature] == pytest.approx(_plain([(r["id"], r["y"], noisy[r["id"]]) for r in labels if r["k"] == k]), abs=1e-9)


def test_many_small_classes_reach_over_many_buckets(spark, bucket_rows):
    rng = np.random.default_rng(8)
    cells = [(i, f"c{rng.integers(150)}", "f", float(v)) for i, v in enumerate(rng.normal(0, 1, 600))]
    df = spark.createDataFrame(cells, "id long, y string, feature string, x double")
    noisy = {r["id"]: r["x"] for r in I._jittered(df, []).collect()}
    got = I.mi_numeric(df).first()["mi"]
    assert got == pytest.approx(_plain([(i, y, noisy[i]) for i, y, _, _ in cells]), abs=1e-9)


def test_numbers_are_put_in_order_once_for_all_shuffles(spark, monkeypatch):
    seen = []
    jittered = I._jittered
    monkeypatch.setattr(I, "_jittered", lambda cells, groups: seen.append(cells.count()) or jittered(cells, groups))
    df = spark.createDataFrame(_rows(), "id long, y string, x double, z double")
    I.permutation_mi(df, "id", "y", ["x", "z"], [], 6).collect()
    assert seen == [2 * 200]


def test_a_repeated_id_counts_once_with_all_its_neighbors(spark, bucket_rows):
    """As in the SQL beside ``mi_numeric``: the nearness counts of rows of one id are added up."""
    rows = [(i, "ab"[i % 2], "f", float(i * i % 97)) for i in range(80)]
    rows += rows[:20] + [(None, "a", "f", 5.0), (None, "b", "f", 60.0)]
    df = spark.createDataFrame(rows, "id long, y string, feature string, x double")
    points = [(r["id"], r["y"], r["x"]) for r in I._jittered(df, []).collect()]
    m = {}
    for i, y, x in points:
        gaps = sorted(abs(x - v) for _, c, v in points if c == y)      # the first is the row's own
        r = gaps[3] * (1 - 1e-10)
        m[i] = m.get(i, 0) + sum(x - r <= v <= x + r for _, _, v in points)
    psi = {n: spark.range(1).select(I.digamma(f"{n}")).first()[0] for n in {*m.values(), 3, len(points)} | {
        sum(c == y for _, c, _ in points) for y in "ab"}}
    per = [psi[sum(c == y for _, c, _ in points)] for _, y, _ in points]
    want = psi[len(points)] + psi[3] - np.mean(per) - np.mean([psi[n] for n in m.values()])
    assert I.mi_numeric(df).first()["mi"] == pytest.approx(max(want, 0), abs=1e-9)


def test_rows_without_a_class_count_among_the_class_sizes(spark):
    """As in the SQL beside ``mi_numeric``: they are no neighbors, but part of N and of the mean over classes."""
    rows = [(i, [None, "a", "b"][i % 3], "f", float(i * i % 97)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y string, feature string, x double")
    noisy = {r["id"]: r["x"] for r in I._jittered(df, []).collect()}
    named = [(y, noisy[i]) for i, y, _, _ in rows if y]
    inside = []
    for y, x in named:
        r = sorted(abs(x - v) for c, v in named if c == y)[3] * (1 - 1e-10)
        inside.append(brute.psi(sum(x - r <= v <= x + r for _, v in named)))
    want = brute.psi(90) + brute.psi(3) - brute.psi(30) - np.mean(inside)
    assert want > 0
    assert I.mi_numeric(df).first()["mi"] == pytest.approx(want, abs=1e-9)
    wide = df.select("id", "y", F.col("x").alias("f"))
    for r in I.permutation_mi(wide, "id", "y", ["f"], [], 2).collect():
        cells = I.numeric_cells(I.permuted_labels(wide, "id", "y", 2).where(F.col("k") == r["k"]), "id", "y", ["f"])
        assert r["mi"] == pytest.approx(I.mi_numeric(cells).first()["mi"], abs=1e-9)


def test_workers_need_no_package():
    """What the tasks run is pickled whole, not by the name of a module that workers may lack."""
    sent = cloudpickle.dumps([N._pack(["feature"], 2, 3), N._search(["feature"], 2, 3), N._close(["feature"], 2)])
    done = subprocess.run([sys.executable, "-c", "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read()); "
                           "assert 'sigscreen' not in sys.modules"], input=sent, cwd="/", env={**os.environ, "PYTHONPATH": ""}, capture_output=True)
    assert done.returncode == 0, done.stderr
