import random

import pytest
from pyspark.sql import functions as F

from sigscreen import Thresholds, Wiring, build_features, rescreen_diff, screen
from sigscreen.operators.verdict import VERDICT_COLUMNS


def _planted(spark, n=600, seed=8):
    """A label with a signal, a copy of itself, a numeric leak, noise, a sparse column and a twin."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.choice("aaabbc")
        x = rnd.gauss({"a": 0, "b": 0.8, "c": 1.6}[y], 1)
        rows.append((
            i, y, y if rnd.random() < 0.6 else rnd.choice("abc"), y.upper(),
            {"a": 0, "b": 10, "c": 20}[y] + rnd.random(), rnd.choice("pqrst"), rnd.gauss(0, 1),
            y if rnd.random() < 0.1 else None, x, 2 * x + 1e-6 * rnd.random(), i))
    return spark.createDataFrame(rows, "id long, y string, signal string, copy string, leak double, "
                                 "noise string, noise_num double, sparse string, x double, "
                                 "twin double, t long").withColumn(
        "ts", F.timestamp_seconds("t")).drop("t")


@pytest.fixture(scope="module")
def result(spark):
    df = _planted(spark)
    return screen(df.drop("y"), df.select("id", "y"), "id", "y", time_col="ts", n_perm=10,
                  trees=10, depth=4)


def test_planted_features_get_their_verdicts(result):
    rows = result.verdicts.collect()
    got = {r["feature"]: (r["recommend"], r["reason"]) for r in rows}
    assert result.verdicts.columns == list(VERDICT_COLUMNS)
    assert [(r["recommend"], -r["mi"]) for r in rows] == sorted(
        (r["recommend"], -r["mi"]) for r in rows)
    assert got["noise"][0] == got["noise_num"][0] == "drop"
    assert got["sparse"] == ("drop", "too sparse")
    assert got["copy"][0] == "investigate" and "explains most" in got["copy"][1]
    assert got["leak"][0] == "investigate" and "suspiciously strong" in got["leak"][1]
    assert got["signal"][0] == "keep"
    assert got["x"][1] == "redundant with twin" and got["twin"][1] == "redundant with x"
    assert "id" not in got and "ts" not in got and "y" not in got


def test_summary_and_charts(result):
    s = result.summary.first()
    assert (s["sample_rows"], s["classes"], s["features"]) == (600, 3, 8)
    assert s["keep"] + s["investigate"] + s["drop"] == 8
    assert 0.9 < s["macro_f1"] <= 1 and 0.9 < s["macro_auc"] <= 1
    assert set(result.charts) >= {"mi_top", "importance_top", "confusion", "spearman",
                                  "class_quartiles"}
    assert result.charts["confusion"].agg(F.sum("n")).first()[0] == 600
    assert result.charts["class_quartiles"].where("q25 > q50 or q50 > q75").count() == 0


def test_closed_loop(spark, result):
    df = _planted(spark)
    again = screen(df.drop("y"), df.select("id", "y"), "id", "y", exclude=["copy", "leak", "ts"],
                   n_perm=10, trees=10, depth=4, charts=False)
    diff = {r["feature"]: r for r in rescreen_diff(result.verdicts, again.verdicts).collect()}
    assert diff["copy"]["after"] is None and diff["copy"]["before"] == "investigate"
    assert diff["signal"]["mi_before"] == pytest.approx(diff["signal"]["mi_after"])
    assert again.summary.first()["macro_f1"] < result.summary.first()["macro_f1"]


def test_thresholds_groups_and_repeated_ids(spark):
    df = _planted(spark).select("id", "y", "signal", "noise", "x")
    twice = df.withColumn("id", F.col("id") % 200)        # each id has several rows
    labels = twice.select("id", "y").dropDuplicates(["id"])
    got = screen(twice.drop("y"), labels, "id", "y", group_col="id", n_perm=5, model="forest",
                 trees=5, depth=3, charts=False, thresholds=Thresholds(max_mi_ratio=0.0))
    assert got.summary.first()["sample_rows"] == 600
    kept = {r["feature"]: r["recommend"] for r in got.verdicts.collect()}
    assert "keep" not in kept.values()


def test_binned_sample_and_no_model(spark):
    df = _planted(spark).select("id", "y", "signal", "leak", "noise_num")
    got = screen(df.drop("y"), df.select("id", "y"), "id", "y", n_perm=5, model=None, sample=300,
                 estimator="binned", charts=False)
    s = got.summary.first()
    assert s["sample_rows"] <= 300 and s["macro_f1"] is None
    assert {r["feature"]: r["recommend"] for r in got.verdicts.collect()}["leak"] == "investigate"


def test_boosted_baseline(spark):
    df = _planted(spark, 200).select("id", "y", "signal", "x")
    got = screen(df.drop("y"), df.select("id", "y"), "id", "y", n_perm=0, model="gbt", trees=3,
                 charts=False)
    assert got.summary.first()["macro_f1"] > 0.3


def test_refusals(spark):
    df = _planted(spark, 60)
    feats, labels = df.drop("y"), df.select("id", "y")
    with pytest.raises(ValueError, match="label cannot"):
        screen(feats, labels, "id", "y", include=["y"])
    with pytest.raises(ValueError, match="group"):
        screen(feats, labels, "id", "y", group_col="y")
    with pytest.raises(ValueError, match="no feature"):
        screen(feats.select("id"), labels, "id", "y")
    with pytest.raises(ValueError, match="2 classes"):
        screen(feats, labels.where("y = 'a'"), "id", "y", n_perm=0, model=None)


def test_build_features_on_a_small_town(spark):
    """The usual inputs with their mess: repeated rows, odd casing, missing values, unlabeled people."""
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "entities": df([("p1", 30.0, "2025-06-30 12:00:00", "ios", "en", " CITY_07"),
                        ("p1", 30.0, "2025-06-30 12:00:00", "ios", "en", " CITY_07"),
                        ("p2", None, None, None, "fr", "somewhere"),
                        ("p3", 50.0, "2025-06-01 00:00:00", "web", "en", "city 12")],
                       "person_id string, age double, signup_at string, device string, "
                       "declared_language string, raw_city_text string"),
        "labels": df([("p1", "city_07"), ("p2", "city_12")], "person_id string, home_city string"),
        "messages": df([("p1", "p2", "t1", "land_city_07 hi", "en"), ("p1", "p2", "t1", "land_city_07 hi", "en"),
                        ("p2", "p1", "t2", None, "en"), ("p3", "p1", "t3", "cityname_city_12", None)],
                       "sender_id string, recipient_id string, ts string, text string, lang string"),
        "docs": df([("p2", "team_city_12 x")], "person_id string, doc_text string"),
        "pings": df([("p1", "w1"), ("p1", "w2"), ("p1", "w1")], "person_id string, tower_id string"),
        "towers": df([("w1", "metro_1"), ("w2", "metro_2")], "tower_id string, region_code string"),
        "transactions": df([("p1", "m1"), ("p1", "m2"), ("p2", "m2")],
                           "person_id string, merchant_id string"),
        "merchants": df([("m1", "City 07 ", False), ("m2", None, True)],
                        "merchant_id string, merchant_city string, is_online boolean"),
        "app_events": df([("p1", "2025-01-01 10:00:00")], "person_id string, ts string").withColumn(
            "ts", F.col("ts").cast("timestamp")),
        "devices": df([("p1", 6.1, 80)], "person_id string, screen_in double, battery int"),
        "ip": df([("p1", "city_07")], "person_id string, ip_city string"),
        "weather": df([("metro_1", 20.0), ("metro_1", 22.0), ("metro_2", 5.0)],
                      "region_code string, temp_c double"),
    }
    rows = {r["person_id"]: r for r in build_features(tables, Wiring()).collect()}
    assert set(rows) == {"p1", "p2", "p3"}
    one, two, three = rows["p1"], rows["p2"], rows["p3"]
    assert len(one) - 2 == 41 and "home_city" not in one.asDict()
    assert one["txt_flavor_top_city"] == "city_07" and one["txt_n_messages"] == 1
    assert (one["deg_out"], one["deg_in"], one["deg_total"]) == (1, 2, 2)
    assert one["reciprocity"] == 1.0 and three["reciprocity"] == 0.0
    assert three["nb_modal_city"] == "city_07" and three["txt_modal_mention_city"] == "city_12"
    assert one["tower_modal_region"] == "metro_1" and one["tower_top_frac"] == pytest.approx(2 / 3)
    assert one["merch_modal_city"] == "city_07" and one["merch_online_frac"] == 0.5
    assert two["merch_modal_city"] is None and two["merch_online_frac"] == 1.0
    assert one["declared_city"] == "city_07" and two["declared_city"] is None
    assert (one["tenure_days"], two["tenure_days"], three["tenure_days"]) == (0, None, 30)
    assert (two["doc_present"], two["doc_len"], two["doc_flavor_top_city"]) == (1, 2, "city_12")
    assert one["doc_present"] == 0 and one["wx_home_region_temp"] == 21.0
    assert three["wx_home_region_temp"] is None and one["act_hour_std"] is None


def test_every_feature_has_a_verdict(spark):
    """A feature whose classes have one row each has no estimate, and is dropped, not lost."""
    from sigscreen import screen

    rows = [(i, float(i), float(i) if i < 2 else None, i % 3) for i in range(30)]
    wide = spark.createDataFrame(rows, "id long, u double, sparse double, c long").withColumn(
        "c", F.col("c").cast("string"))
    labels = spark.createDataFrame([(i, f"k{i}") for i in range(30)], "id long, y string")
    got = screen(wide, labels, "id", "y", n_perm=2, model=None, charts=False)
    verdicts = {r["feature"]: r["recommend"] for r in got.verdicts.collect()}
    assert set(verdicts) == {"u", "sparse", "c"} and verdicts["u"] == "drop"


def test_every_outcome_occurs_in_the_checked_screen():
    import duckdb

    from sigscreen.workload import QUERIES

    con = duckdb.connect()
    for t in ("customer", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    reasons = {r[0].split(" with ")[0] for r in con.execute(f"SELECT reason FROM ({QUERIES['screen_verdicts'].sql})").fetchall()}
    assert len(reasons) == 8
