"""Boosted trees: planted signal, very many category levels, and one result whatever the plan."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from sigscreen.operators import baseline as B
from sigscreen.operators import boosting as X

QUICK = X.Settings(rounds=3, depth=2, bins=8, rate=0.3)


def _rows(spark, x, y, fold=None):
    data = [(i, float(c), int(i % 3 if fold is None else fold[i]), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, y double, fold int, v array<double>").withColumn("features", array_to_vector("v"))
    return df.drop("v").repartition(3)


def _planted(n=900, levels=12, seed=2):
    rng = np.random.default_rng(seed)
    num, cat, noise = rng.normal(size=n), rng.integers(0, levels, n), rng.integers(0, 5, n)
    y = np.where(cat % 2 == 0, (num > 0.3) * 1, 2)
    return np.stack([num, cat, noise], 1), y


def _scores(rows):
    return {r["id"]: np.array(r["scores"]) for r in rows.collect()}


def test_an_interaction_of_number_and_category_is_learned(spark):
    x, y = _planted()
    df = _rows(spark, x, y)
    model, scored = X.fit(df, 1, None, X.Settings(rounds=6, depth=3, bins=16, rate=0.4))
    done = X.predict(model, df, ["id", "y"])
    assert done.where("prediction <> y").count() <= 20          # one class is cut at a bin's edge
    fit = _scores(scored)
    for r in done.collect():                                    # all rounds in one pass give what the fit gave round by round
        e = np.exp(fit[r["id"]] - fit[r["id"]].max())
        assert r["scores"] == pytest.approx(list(e / e.sum()), abs=1e-12)
    again = X.fit(df.repartition(7), 1, None, X.Settings(rounds=6, depth=3, bins=16, rate=0.4))[1]
    assert all(np.abs(v - fit[i]).max() < 1e-9 for i, v in _scores(again).items())


@pytest.mark.parametrize("change", ["no broadcast", "many buckets"])
def test_plans_for_wide_categories_give_the_same(spark, monkeypatch, change):
    x, y = _planted(400, 40)
    df = _rows(spark, x, y)
    model, want = X.fit(df, 1, "fold", QUICK)
    shown = {r["id"]: r["scores"] for r in X.predict(model, df, ["id"], 1).collect()}
    if change == "no broadcast":
        monkeypatch.setattr(X, "SMALL_BYTES", 0)
    else:
        monkeypatch.setattr(X, "ROWS_PER_BUCKET", 5)
    model, got = X.fit(df, 1, "fold", QUICK)
    got, want = _scores(got), _scores(want)
    assert all(np.abs(got[i] - want[i]).max() < 1e-9 for i in want) and len(got) == 400
    for r in X.predict(model, df, ["id"], 1).collect():
        assert r["scores"] == pytest.approx(shown[r["id"]], abs=1e-9)


def test_a_category_of_hundreds_of_levels_stays_one(spark):
    rng = np.random.default_rng(8)
    n, levels = 12_000, 400
    cat = rng.integers(0, levels, n)
    y = rng.permutation(levels)[cat] % 2                        # the code says nothing, the category everything
    df = _rows(spark, cat[:, None], y)
    model, _ = X.fit(df, 0, None, X.Settings(rounds=1, depth=1))
    assert X.predict(model, df, ["y"]).where("prediction <> y").count() == 0


def test_folds_are_not_seen(spark):
    x, y = _planted(600)
    df = _rows(spark, x, y)
    got = {r["id"]: (r["prediction"], r["scores"]) for r in B.out_of_fold(df, model="boosted", numeric=1, rounds=3, depth=2, bins=8).collect()}
    alone, _ = X.fit(df.where("fold <> 1"), 1, None, X.Settings(rounds=3, depth=2, bins=8))
    assert len(got) == 600 and len(got[0][1]) == 3
    # the number's bins are cut over all rows, so only the categories can be compared with a fit on the other folds alone
    cats = _rows(spark, x[:, 1:], y)
    got = {r["id"]: r["scores"] for r in B.out_of_fold(cats, model="boosted", rounds=3, depth=2).collect()}
    alone, _ = X.fit(cats.where("fold <> 1"), 0, None, X.Settings(rounds=3, depth=2))
    for r in X.predict(alone, cats.where("fold = 1"), ["id"]).collect():
        assert r["scores"] == pytest.approx(got[r["id"]], abs=1e-9)


def test_importance_names_what_matters(spark):
    x, y = _planted(600)
    df = _rows(spark, x, y)
    got = {r["feature"]: r["importance"] for r in B.permutation_importance(
        df, ["num", "cat", "noise"], "boosted", repeats=2, numeric=1, rounds=4, depth=3, rate=0.4).collect()}
    assert got["num"] > 0.1 and got["cat"] > 0.2 and abs(got["noise"]) < 0.05


def test_one_class_and_no_cut(spark):
    df = _rows(spark, np.ones((30, 1)), np.zeros(30))
    model, scored = X.fit(df, 1, None, QUICK)
    assert {tuple(r["scores"]) for r in scored.select("scores").distinct().collect()} and model.classes == 1
    assert X.predict(model, df, ["id"]).where("prediction <> 0").count() == 0
    empty, scored = X.fit(df.limit(0), 1, None, QUICK)
    assert scored.count() == 0 and X.predict(empty, df.limit(0), ["id"]).count() == 0
