import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigscreen.operators import ordering as O


@pytest.fixture(params=[10, 200_000], ids=["many-buckets", "one-bucket"])
def bucket_rows(request, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", request.param)
    monkeypatch.setattr(O, "SKETCH_SHARE", 1)
    return request.param


def _rows(n=400, hot=0.4, seed=3):
    """Two groups; one value holds ``hot`` of the rows."""
    rnd = random.Random(seed)
    return [(i, "g" if i % 3 else "h",
             1.5 if rnd.random() < hot else round(rnd.gauss(0, 2), 1)) for i in range(n)]


def _h(seed, *parts):
    return hashlib.md5("|".join([*map(str, parts), str(seed)]).encode()).hexdigest()


def test_hash_positions(spark):
    rows = _rows()
    got = {r["id"]: r["pos"] for r in O.hash_positions(
        spark.createDataFrame(rows, "id long, g string, x double"), ["id"], ["g"], 7).collect()}
    for g in "gh":
        ids = sorted((i for i, gg, _ in rows if gg == g), key=lambda i: _h(7, i))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_value_positions_with_hot_value(spark, bucket_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = {r["id"]: r["pos"] for r in O.value_positions(df, "x", ["id"], ["g"]).collect()}
    for g in "gh":
        mine = sorted((x, _h(0, i), i) for i, gg, x in rows if gg == g)
        assert [got[i] for _, _, i in mine] == list(range(1, len(mine) + 1))


def test_positions_with_many_listed_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(O, "SKETCH_SHARE", 1)
    monkeypatch.setattr(O, "SMALL_BYTES", 0)         # the points are joined by salted group, not broadcast
    df = spark.createDataFrame(_rows(), "id long, g string, x double")
    got = O.value_positions(df, "x", ["id"], ["g"])
    assert got.columns == ["id", "g", "x", "pos"] and got.count() == 400
    for g, n in got.groupBy("g").agg(F.count_distinct("pos")).collect():
        assert sorted(r["pos"] for r in got.where(F.col("g") == g).collect()) == list(range(1, n + 1))


def test_hot_value_is_cut_into_sub_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(O, "SKETCH_SHARE", 1)
    df = spark.createDataFrame(_rows(2000), "id long, g string, x double")
    splits = O.Splits(df, ["g"], "x")
    sizes = splits.bucketed(df, "x", ["id"]).groupBy("g", "_b", "_sub").count()
    assert sizes.agg(F.max("count")).first()[0] < 40


def test_running_weights(spark, bucket_rows):
    rows = _rows()
    counts = O.value_counts(spark.createDataFrame(rows, "id long, g string, x double"), ["g"], "x")
    for r in O.running_weights(counts, "x", "n", ["g"], tied="t").collect():
        mine = [x for _, g, x in rows if g == r["g"]]
        assert r["before"] == sum(x < r["x"] for x in mine)
        assert r["t"] == r["n"] == sum(x == r["x"] for x in mine)


def test_exact_quantiles(spark, bucket_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, g string, x double")
    probs = {"lo": 0.0, "a": 0.25, "m": 0.5, "z": 0.95, "hi": 1.0}
    for r in O.exact_quantiles(df, ["g"], "x", probs).collect():
        mine = [x for _, g, x in rows if g == r["g"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(mine, p * 100), abs=1e-12)


def test_quantile_of_one_value(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None)], "g string, x double")
    got = O.exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()
    assert [(r["g"], r["m"]) for r in got] == [("a", 2.0)]
