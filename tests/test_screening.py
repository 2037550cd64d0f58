import hashlib
import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigscreen.operators import information as I
from sigscreen.operators import ordering as O
from sigscreen.operators import ranks as R
from sigscreen.operators.baseline import macro_auc, macro_f1
from sigscreen.operators.stability import slice_mi, stability_cv, time_slices
from sigscreen.operators.verdict import class_quartiles, verdicts


@pytest.fixture(params=[25, 200_000], ids=["many-buckets", "one-bucket"])
def bucket_rows(request, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", request.param)
    monkeypatch.setattr(O, "SKETCH_SHARE", 1)
    monkeypatch.setattr(I, "BLOCK", 8 if request.param == 25 else 100_000)
    return request.param


def _numbers(n=240, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2]).astype(object)
    y[0] = "single"
    x = rng.normal(0, 1, n) + (y == "b") * 1.2
    z = np.round(x, 1)
    z[: n // 3] = 0.0      # one value holds a third of the rows
    return x, z, y


def _cells(spark, cols, y):
    rows = [(i, str(c), f, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v))
            for f, xs in cols.items() for i, (v, c) in enumerate(zip(xs, y))]
    return spark.createDataFrame(rows, "id long, y string, feature string, x double")


def _counts(spark, x, y):
    return spark.createDataFrame(list(zip(map(str, x), map(str, y))), "x string, y string").groupBy(
        F.lit("f").alias("feature"), "x", "y").agg(F.count(F.lit(1)).alias("n"))


def test_mi_exact_and_independent(spark):
    y = list("abcd") * 4
    assert I.mi_discrete(_counts(spark, y, y)).first()["mi"] == pytest.approx(math.log(4))
    x = ["u"] * 8 + ["v"] * 8
    assert I.mi_discrete(_counts(spark, x, y)).first()["mi"] == pytest.approx(0, abs=1e-12)


def test_mi_bounds_and_relabeling(spark):
    _, z, y = _numbers()
    x = [int(abs(v) * 2) for v in z]
    got = I.mi_discrete(_counts(spark, x, y)).first()["mi"]
    assert got == pytest.approx(brute.mi(x, y))
    assert 0 <= got <= min(brute.entropy(x), brute.entropy(y))
    swap = {"a": "q", "b": "a", "c": "b", "single": "z"}
    assert I.mi_discrete(_counts(spark, x, [swap[c] for c in y])).first()["mi"] == pytest.approx(got)


def test_digamma(spark):
    from sigscreen.functions.columns import digamma
    for r in spark.range(1, 200).select("id", digamma("id").alias("p")).collect():
        assert r["p"] == pytest.approx(brute.psi(r["id"]), abs=1e-9)


def test_mi_numeric_against_search(spark, bucket_rows):
    x, z, y = _numbers()
    cells = _cells(spark, {"x": x, "z": z}, y)
    got = {r["feature"]: r["mi"] for r in I.mi_numeric(cells).collect()}
    assert got["x"] == pytest.approx(brute.mi_knn(x, y), abs=1e-9)
    # Ties are broken by noise, so the search runs on the same noisy values.
    noisy = {r["id"]: r["x"] for r in I._jittered(cells.where("feature = 'z'"), []).collect()}
    zz = np.array([noisy[i] for i in range(len(z))])
    assert np.abs(zz - z).max() < 1e-9
    assert got["z"] == pytest.approx(brute.mi_knn(zz, y), abs=1e-9)


def test_permuted_labels_follow_the_hash_order(spark):
    y = ["a"] * 50 + ["b"] * 30 + ["c"] * 7
    df = spark.createDataFrame(list(enumerate(y)), "id long, y string")
    rows = I.permuted_labels(df, "id", "y", 3, seed=4).collect()
    for k in (1, 2, 3):
        got = {r["id"]: r["y"] for r in rows if r["k"] == k}
        order = sorted(range(len(y)), key=lambda i: hashlib.md5(f"{i}|{k}|4".encode()).hexdigest())
        assert [got[i] for i in order] == sorted(y)


def test_null_separates_signal_from_noise(spark):
    rng = np.random.default_rng(1)
    y = rng.choice(list("abc"), 300)
    good = [c if rng.random() < 0.7 else "a" for c in y]
    bad = rng.choice(list("pqrs"), 300)
    num = rng.normal(0, 1, 300) + (y == "a")
    df = spark.createDataFrame(
        [(i, str(y[i]), str(good[i]), str(bad[i]), float(num[i])) for i in range(300)],
        "id long, y string, good string, bad string, num double")
    null = {r["feature"]: r["null_p95"] for r in I.null_p95(
        I.permutation_mi(df, "id", "y", ["num"], ["good", "bad"], 12)).collect()}
    mi = {r["feature"]: r["mi"] for r in I.mi_discrete(
        I.category_counts(df, "y", ["good", "bad"])).collect()}
    assert mi["good"] > 3 * null["good"] and mi["bad"] < 1.5 * null["bad"]
    assert brute.mi_knn(num, y) > null["num"]


def test_auc_ties_and_sparse(spark):
    x, y = [1, 1, 2, 2] * 5, ["p", "n", "p", "n"] * 5
    cells = _cells(spark, {"x": x, "neg": [-v for v in x], "few": x[:19] + [None]}, y)
    got = {r["feature"]: r["best_auc"] for r in R.best_ovr_auc(cells).collect()}
    assert got == {"x": 0.5, "neg": 0.5, "few": None}


def test_auc_and_kruskal_against_search(spark, bucket_rows):
    x, z, y = _numbers()
    cells = _cells(spark, {"x": x, "z": z, "nx": -x}, y)
    got = {r["feature"]: r["best_auc"] for r in R.best_ovr_auc(cells).collect()}
    for f, v in (("x", x), ("z", z), ("nx", -x)):
        each = [brute.auc(v, y == c) for c in np.unique(y)]
        assert got[f] == pytest.approx(max(0.5, *[max(a, 1 - a) for a in each]))
    assert got["x"] == pytest.approx(got["nx"])
    h = {r["feature"]: r["h"] for r in R.kruskal_h(cells).collect()}
    assert h["x"] == pytest.approx(brute.kruskal(x, y))
    assert h["z"] == pytest.approx(brute.kruskal(z, y))


def test_spearman_is_pairwise_complete(spark, bucket_rows):
    x, z, _ = _numbers()
    a, b, c = x.copy(), z.copy(), x**3 + 0.01 * z
    a[::7], c[::5], nan = np.nan, np.nan, float("nan")
    d = np.where(np.isnan(a), nan, -a)
    cols = {"a": a, "b": b, "c": c, "d": d, "e": x}
    df = spark.createDataFrame(
        [(i, *[None if math.isnan(v[i]) else float(v[i]) for v in cols.values()])
         for i in range(len(x))], "id long, " + ", ".join(f"{n} double" for n in cols))
    pairs = R.spearman_pairs(df, "id", list(cols))
    got = {(r["a"], r["b"]): r["rho"] for r in pairs.collect()}
    for m in cols:
        for n in cols:
            if m != n:
                assert got[m, n] == pytest.approx(brute.spearman(cols[m], cols[n])), (m, n)
    best = {r["feature"]: r["redundant_with"] for r in R.spearman_redundancy(pairs).collect()}
    assert best["a"] == "d" and best["d"] == "a" and "b" not in best


def test_slices_of_six(spark):
    rows = [(i, f"2024-01-0{i + 1} 00:00:00") for i in range(6)] + [(6, None)]
    df = spark.createDataFrame(rows, "id long, ts string")
    got = [(r["id"], r["slice"]) for r in time_slices(df, "id", "ts").orderBy("id").collect()]
    assert [s for _, s in got] == [0, 0, 1, 2, 3, 3]


@pytest.mark.parametrize("n", [4, 5, 7, 13, 101])
def test_slices_match_quantile_cuts(spark, n):
    import pandas as pd
    df = spark.range(n).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    got = [r["slice"] for r in time_slices(df, "id", "ts").orderBy("id").collect()]
    assert got == pd.qcut(pd.Series(range(n)).rank(method="first"), 4, labels=False).tolist()


def test_stability_by_slice(spark):
    rng = np.random.default_rng(2)
    n = 400
    y = rng.choice(list("ab"), n)
    steady = y.copy()
    fades = np.where(np.arange(n) < 100, y, rng.choice(list("ab"), n))
    num = rng.normal(0, 1, n)
    num[::9] = np.nan
    df = spark.createDataFrame(
        [(i, str(y[i]), i, str(steady[i]), str(fades[i]), None if np.isnan(num[i]) else float(num[i]))
         for i in range(n)], "id long, y string, s long, steady string, fades string, num double"
    ).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    mi = slice_mi(df, "id", "y", "ts", ["num"], ["steady", "fades"]).collect()
    slices = np.ceil(np.arange(n) * 4 / (n - 1)).astype(int) - 1
    slices = np.maximum(slices, 0)
    for r in mi:
        if r["feature"] != "num":
            v = steady if r["feature"] == "steady" else fades
            here = slices == r["slice"]
            assert r["mi"] == pytest.approx(brute.mi(v[here], y[here]), abs=1e-9)
    cv = {r["feature"]: r["stability_cv"] for r in stability_cv(
        spark.createDataFrame(mi)).collect()}
    per = [r["mi"] for r in mi if r["feature"] == "fades"]
    assert len(per) == 4
    assert cv["fades"] == pytest.approx(np.std(per, ddof=1) / (np.mean(per) + 1e-9))
    assert cv["steady"] < 0.1 < cv["fades"] and cv["fades"] > 1


def test_macro_scores(spark):
    y, p = list("aabbbcc"), list("abbbaca")
    counts = spark.createDataFrame(list(zip(y, p)), "y string, p string").groupBy("y", "p").agg(
        F.count(F.lit(1)).alias("n"))
    assert macro_f1(counts, "y", "p").first()[0] == pytest.approx(brute.macro_f1(y, p))
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 60)
    scores = rng.random((60, 3)) + np.eye(3)[labels] * 0.3
    df = spark.createDataFrame([(float(a), [float(v) for v in s]) for a, s in zip(labels, scores)],
                               "y double, scores array<double>")
    want = np.mean([brute.auc(scores[:, c], labels == c) for c in range(3)])
    assert macro_auc(df).first()[0] == pytest.approx(want)


def test_types_and_encoding(spark):
    rows = [(i, float(i), i % 4, None if i % 5 == 0 else "ab"[i % 2], i % 2 == 0,
             None if i == 3 else float(i * i)) for i in range(40)]
    df = spark.createDataFrame(
        rows, "id long, many double, small int, cat string, flag boolean, holes double")
    kinds = {r["feature"]: r["kind"] for r in I.feature_types(
        df, ["many", "small", "cat", "flag", "holes"]).collect()}
    assert kinds == {"many": "numeric", "small": "categorical", "cat": "categorical",
                     "flag": "categorical", "holes": "numeric"}
    out = {r["id"]: r for r in I.encode_features(df, "id", ["holes"], ["cat", "flag"]).collect()}
    assert out[3]["holes"] == np.median([i * i for i in range(40) if i != 3])
    assert out[0]["cat"] == 0 and {out[1]["cat"], out[2]["cat"]} == {1, 2}
    assert len({r["flag"] for r in out.values()}) == 2


def test_many_levels_are_coded_by_join(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1200, "hot").otherwise(
        F.col("id").cast("string")).alias("c"))
    out = I.encode_features(df, "id", [], ["c"]).collect()
    assert len(out) == 3000 and len({r["c"] for r in out}) == 1801
    assert {r["c"] for r in out} == set(map(float, range(1, 1802)))


def test_verdict_order(spark):
    base = dict(mi=1.0, mi_ratio=0.5, null_p95=0.1, best_auc=0.6, importance=0.1, coverage=1.0,
                stability_cv=0.1, redundant_with=None)
    cases = {
        "keep": ({}, "keep"),
        "no_signal": (dict(mi=0.1, coverage=0.1, best_auc=0.99), "drop"),
        "sparse": (dict(coverage=0.19), "drop"),
        "edge_coverage": (dict(coverage=0.2), "keep"),
        "auc": (dict(best_auc=0.98, mi_ratio=0.9), "investigate"),
        "ratio": (dict(mi_ratio=0.81, redundant_with="z"), "investigate"),
        "edge_ratio": (dict(mi_ratio=0.80), "keep"),
        "redundant": (dict(redundant_with="z", stability_cv=2.0), "investigate"),
        "unstable": (dict(stability_cv=1.5), "investigate"),
        "weak": (dict(importance=0.0, mi=0.12), "investigate"),
        "no_auc": (dict(best_auc=None, stability_cv=None), "keep"),
    }
    rows = [(name, *[{**base, **over}[c] for c in base]) for name, (over, _) in cases.items()]
    got = {r["feature"]: (r["recommend"], r["reason"]) for r in verdicts(spark.createDataFrame(
        rows, "feature string, mi double, mi_ratio double, null_p95 double, best_auc double, "
        "importance double, coverage double, stability_cv double, redundant_with string")).collect()}
    assert {n: v[0] for n, v in got.items()} == {n: v for n, (_, v) in cases.items()}
    assert got["no_signal"][1].startswith("no signal") and got["sparse"][1] == "too sparse"
    assert got["auc"][1].startswith("suspiciously") and got["ratio"][1].startswith("explains")
    assert got["redundant"][1] == "redundant with z" and got["weak"][1].startswith("weak")


def test_quartiles_by_class(spark, bucket_rows):
    x, _, y = _numbers()
    for r in class_quartiles(_cells(spark, {"x": x}, y)).collect():
        mine = x[y == r["y"]]
        for q in (25, 50, 75):
            assert r[f"q{q}"] == pytest.approx(np.percentile(mine, q))


@pytest.mark.parametrize("cells", [R.CELLS, 900])
def test_spearman_of_hundreds_of_columns(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "CELLS", cells)
    rng = np.random.default_rng(12)
    n, width = 150, 300 if cells == R.CELLS else 14
    base = rng.normal(size=(n, 10))
    patterns = [rng.random(n) < p for p in np.linspace(0, 0.6, 12)]              # 12 sets of missing rows, the first empty
    table = np.round(base[:, rng.integers(0, 10, width)] + rng.normal(size=(n, width)), 1)
    for j in range(width):
        table[patterns[j % 12], j] = np.nan
    cols = [f"c{j:03d}" for j in range(width)]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(table)],
                               "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r["a"], r["b"]): r["rho"] for r in R.spearman_pairs(df, "id", cols).collect()}
    assert len(got) == width * (width - 1)
    for i in rng.integers(0, width, 60):
        for j in rng.integers(0, width, 3):
            if i != j:
                assert got[cols[i], cols[j]] == pytest.approx(brute.spearman(table[:, i], table[:, j]), abs=1e-9)


def test_labels_of_very_many_classes_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = np.concatenate([np.arange(50_000), rng.integers(0, 50, 3000)])             # 50,000 classes, some of them large
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, y int")
    for rows in (100_000, 1):                # the prefixes that suffice, and longer ones
        monkeypatch.setattr(I, "ROWS_PER_BUCKET", rows if rows > 1 else 5)
        got = I.permuted_labels(df, "id", "y", 2, 3).collect()
        assert len(got) == 2 * len(y)
        for k in (1, 2):
            order = sorted(range(len(y)), key=lambda i: hashlib.md5(f"{i}|{k}|3".encode()).hexdigest())
            want = dict(zip(order, np.sort(y).tolist()))
            assert {r["id"]: r["y"] for r in got if r["k"] == k} == want


def test_labels_as_text_and_one_class(spark):
    df = spark.createDataFrame([(i, "b" if i % 3 else "a") for i in range(40)], "id long, y string")
    got = I.permuted_labels(df, "id", "y", 3).groupBy("k", "y").count().collect()
    assert {(r["k"], r["y"]): r["count"] for r in got} == {(k, c): n for k in (1, 2, 3) for c, n in (("a", 14), ("b", 26))}
    one = I.permuted_labels(df.withColumn("y", F.lit("a")), "id", "y", 2)
    assert one.count() == 80 and one.where("y <> 'a' or y is null").count() == 0
    assert I.permuted_labels(df.limit(0), "id", "y", 2).count() == 0
