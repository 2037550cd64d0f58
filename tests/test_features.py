import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigscreen.functions.columns import norm_category, region_of, to_number
from sigscreen.operators import clean, counts, events, folds, joins, text
from sigscreen.operators import graph as G
from sigscreen.operators.vectors import fold_centroids, oof_centroids


def test_modal_ties(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, None)]
    got = {r["k"]: r for r in counts.modal_category(
        spark.createDataFrame(rows, "k long, c string"), "k", "c", "m").collect()}
    assert set(got) == {1, 2}
    assert got[1]["m"] == "a" and got[1]["m_frac"] == 0.5
    assert got[1]["m_entropy"] == pytest.approx(math.log(2)) and got[2]["m_entropy"] == 0


def test_norm_city(spark):
    given = ["City 07", " CITY_07 ", "City 0x", None, "city07", "CITY 123"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i long, v string")
    got = [r["c"] for r in df.select("i", norm_category("v").alias("c")).orderBy("i").collect()]
    assert got == ["city_07", "city_07", None, None, "city_07", "city_12"]
    regions = df.select("i", region_of(norm_category("v")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in regions] == ["metro_1", "metro_1", None, None, "metro_1", "metro_2"]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([(v,) for v in ["1.5", "x", "NaN", None]], "v string")
    assert [r[0] for r in df.select(to_number("v")).collect()] == [1.5, None, None, None]


def test_dedup_key_keeps_the_first(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 5, "b"), (1, 5, "a"), (2, 9, "z")],
                               "k long, o long, v string")
    got = clean.dedup_key(df, ["k"], ["o", "v"]).collect()
    assert {(r["k"], r["o"], r["v"]) for r in got} == {(1, 5, "a"), (2, 9, "z")}


def test_reciprocity(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "d"), ("a", "b")],
                                  "s string, r string")
    got = {r["a"]: r["reciprocity"] for r in G.reciprocity(edges, "s", "r").collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 0.0, "d": 0.0}
    deg = {r["a"]: (r["deg_out"], r["deg_in"], r["deg_total"])
           for r in G.degrees(edges, "s", "r").collect()}
    assert deg["a"] == (3, 1, 2) and deg["d"] == (0, 1, 1)


def _oof(spark, edges, people):
    pairs = G.pair_counts(spark.createDataFrame(edges, "s string, r string"), "s", "r")
    known = spark.createDataFrame(people, "id string, lab string, fold int")
    return {r["id"]: r for r in G.oof_neighbor_labels(pairs, known, "id", "lab", "nb").collect()}


def test_out_of_fold_neighbors(spark):
    # p and q share a fold, r is in the other, u is unlabeled.
    people = [("p", "x", 0), ("q", "y", 0), ("r", "z", 1), ("u", None, -1)]
    edges = [("p", "q"), ("p", "r"), ("p", "r"), ("u", "p"), ("u", "q"), ("u", "q"), ("x", "p")]
    got = _oof(spark, edges, people)
    assert got["p"]["nb"] == "z" and got["p"]["nb_frac"] == 1.0     # q is in p's fold
    assert got["p"]["nb_labeled_frac"] == pytest.approx(2 / 4)      # repeats count, over 4 contacts
    assert got["u"]["nb"] == "y" and got["u"]["nb_frac"] == pytest.approx(2 / 3)
    assert got["r"]["nb"] == "x"
    assert "x" not in got                                           # not an entity
    flipped = _oof(spark, edges, [("p", "other", 0), *people[1:]])
    assert flipped["p"] == got["p"]                                 # own label is never seen


def test_labeled_share_may_exceed_one(spark):
    got = _oof(spark, [("a", "b")] * 3, [("a", None, -1), ("b", "x", 0)])
    assert got["a"]["nb_labeled_frac"] == 3.0


def test_labels_need_folds(spark):
    pairs = G.pair_counts(spark.createDataFrame([("a", "b")], "s string, r string"), "s", "r")
    with pytest.raises(ValueError):
        G.oof_neighbor_labels(pairs, spark.createDataFrame([("a", "x")], "id string, lab string"),
                              "id", "lab")


def test_folds_partition_the_labeled(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 80, F.when(
        F.col("id") % 4 == 0, "rare").otherwise("common")).alias("lab"))
    got = folds.stratified_folds(df, "id", "lab").collect()
    assert len({r["id"] for r in got}) == len(got) == 103
    assert {r["fold"] for r in got if r["lab"] is None} == {-1}
    for lab in ("rare", "common"):
        sizes = np.bincount([r["fold"] for r in got if r["lab"] == lab], minlength=5)
        assert sizes.max() - sizes.min() <= 1


def test_group_folds_and_leakage(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).alias("g"))
    dealt = folds.group_folds(df, "g")
    sizes = [r["n"] for r in dealt.groupBy("fold").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) <= 18
    assert folds.group_leakage(df.join(dealt.select("g", "fold"), "g"), "g").count() == 0
    mixed = df.withColumn("fold", (F.col("id") % 5).cast("int"))
    assert folds.group_leakage(mixed, "g").count() == 7
    two = folds.group_folds(df.where("g < 2"), "g").collect()
    assert {r["fold"] for r in two} == {0, 1}


def test_groups_go_to_the_lightest_fold():
    r = random.Random(1)
    for _ in range(1500):
        k, sizes = r.randint(1, 6), {r.choice([1, 1, 2, 3, 5, 8, 50, 1000]): r.randint(1, 40) for _ in range(r.randint(0, 5))}
        got = {}
        for size, first, last, turn in folds.lightest_runs(list(sizes.items()), k):
            got |= {(size, p): turn[(p - first) % len(turn)] for p in range(first, last + 1)}
        loads = [0] * k
        for size in sorted(sizes, reverse=True):
            for p in range(1, sizes[size] + 1):
                fold = loads.index(min(loads))
                assert got[size, p] == fold
                loads[fold] += size
        assert len(got) == sum(sizes.values())
    assert len(folds.lightest_runs([(1, 10**12), (10**8, 1), (7, 10**6)], 5)) < 20


def test_one_giant_group_leaves_the_rest_level(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, -1).otherwise(F.col("id")).alias("g"))
    sizes = sorted(r["n"] for r in folds.group_folds(df, "g").groupBy("fold").agg(F.sum("n").alias("n")).collect())
    assert sizes == [75, 75, 75, 75, 700]
    assert folds.group_folds(df.limit(0), "g").count() == 0


def test_hot_keys_are_salted_without_changing_the_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_ROWS", 100)
    big = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(
        F.col("id")).alias("k"))
    assert joins.hot_keys(big, "k") == [-1]
    lookup = big.select("k").distinct().withColumn("v", F.col("k") * 2).where("k <> 1")
    for how in ("inner", "left"):
        salted = joins.lookup_join(big, lookup, "k", how)
        plain = big.join(lookup, "k", how)
        key = [F.count(F.lit(1)), F.sum("v"), F.count("v"), F.sum("id")]
        assert salted.columns == plain.columns
        assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
        assert salted.agg(*key).first() == plain.agg(*key).first()


def test_small_lookup_is_weighed(spark, monkeypatch):
    df = spark.range(50).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert joins.is_small(df)
    monkeypatch.setattr(joins, "SMALL_BYTES", 2000)
    assert not joins.is_small(df) and joins.is_small(df.limit(3))


def test_concat_in_parts(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(25)] + [(2, 0, None), (2, 1, "x")],
                               "k long, o long, t string")
    got = counts.concat_text(df, "k", "t", "o", ["k"], 10).orderBy("k", "part").collect()
    assert [r["part"] for r in got] == [0, 1, 2, 0]
    assert " ".join(r["text"] for r in got[:3]) == " ".join(f"t{i}" for i in range(25))


def test_concat_brings_no_keys_to_the_driver(spark, monkeypatch):
    df = spark.range(100_000).select((F.col("id") % 50_000).alias("k"), F.col("id").alias("o"),
                                     F.col("id").cast("string").alias("t"))
    met, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        met.append(len(rows))
        return rows
    monkeypatch.setattr(type(df), "collect", counted)
    whole = counts.concat_text(df, "k", "t", "o", ["k"])
    assert sum(met) <= 2
    assert whole.count() == 50_000
    assert whole.where("k = 7").first()["text"] == "7 50007"


def test_marker_block_equals_its_parts(spark):
    rows = [(1, "land_city_03 slang_city_03 cityname_city_09"), (1, "xteam_city_04"),
            (2, "no marker"), (3, "cityname_city_01 cityname_city_02"), (4, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    both = {r["k"]: r.asDict() for r in text.marker_block(df, "k", "t").collect()}
    for part in (text.text_marker_profile(df, "k", "t"), text.text_mentions(df, "k", "t")):
        for r in part.collect():
            for c, v in r.asDict().items():
                assert both[r["k"]][c] == (pytest.approx(v) if isinstance(v, float) else v)
    assert both[1]["txt_flavor_top_city"] == "city_03"
    assert both[1]["txt_flavor_top_frac"] == pytest.approx(2 / 3)
    assert both[3]["txt_modal_mention_city"] == "city_01" and both[3]["txt_flavor_top_city"] is None
    assert set(both) == {1, 3}


def test_text_style(spark):
    given = {1: ["Go www.x.y http://z", "a b  a \U0001F600"], 2: ["", "   "]}
    df = spark.createDataFrame([(k, t) for k, ts in given.items() for t in ts], "k long, t string")
    got = {r["k"]: r for r in text.text_style(df, "k", "t").collect()}
    words = " ".join(given[1]).split()
    assert got[1]["txt_total_tokens"] == len(words)
    assert got[1]["txt_vocab_richness"] == pytest.approx(len(set(words)) / len(words))
    assert got[1]["txt_url_frac"] == pytest.approx(2 / len(words))
    assert got[1]["txt_emoji_frac"] == pytest.approx(1 / len(words))
    assert (got[2]["txt_total_tokens"], got[2]["txt_vocab_richness"]) == (0, 0.0)


def test_message_counts_and_mode(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, None)],
                               "k long, l string")
    got = {r["k"]: tuple(r)[1:] for r in text.message_counts(df, "k", "l").collect()}
    assert got == {1: (5, "a"), 2: (1, None)}


def test_one_event_has_no_deviation(spark):
    df = spark.createDataFrame([(1, "2024-01-01 23:10:00"), (2, "2024-01-01 23:00:00"),
                                (2, "2024-01-02 01:00:00")], "k long, t string").withColumn(
        "t", F.col("t").cast("timestamp"))
    got = {r["k"]: r for r in events.hour_stats(df, "k", "t").collect()}
    assert got[1]["act_hour_std"] is None and got[1]["act_hour_mean"] == 23
    clock = {r["k"]: r for r in events.hour_circular(df, "k", "t").collect()}
    assert min(clock[2]["hour_circ_mean"], 24 - clock[2]["hour_circ_mean"]) < 1e-9


def test_tenure_counts_whole_days(spark):
    df = spark.createDataFrame([(1, "2025-06-30 00:00:01"), (2, "2025-07-01 00:00:01"), (3, None)],
                               "k long, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r["k"]: r["tenure_days"] for r in events.tenure(df, "k", "t", "2025-07-01").collect()}
    assert got == {1: 0, 2: -1, 3: None}


def test_amount_shape(spark):
    x = [1.0, 2.0, 2.0, 7.0]
    got = events.amount_shape(spark.createDataFrame([(1, v) for v in x], "k long, v double"),
                              "k", "v").first()
    p = np.array(x) / sum(x)
    z = (np.array(x) - 3) / np.std(x)
    assert got["amount_cv"] == pytest.approx(np.std(x, ddof=1) / 3)
    assert got["amount_skew"] == pytest.approx((z**3).mean())
    assert got["amount_entropy"] == pytest.approx(-(p * np.log(p)).sum())


def test_centroids_leave_out_the_own_fold(spark):
    rows = [(0, "a", 0, [0.0, 0.0]), (1, "a", 1, [2.0, 0.0]), (2, "b", 0, [5.0, 5.0]),
            (3, "b", 1, [7.0, 5.0]), (4, None, -1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, lab string, fold int, v array<double>")
    centers = {(r["fold"], r["lab"]): r["centroid"] for r in fold_centroids(
        df, "v", "lab").collect()}
    assert centers[0, "a"] == [2.0, 0.0] and centers[-1, "a"] == [1.0, 0.0]
    got = {(r["id"], r["lab"]): r["distance"] for r in oof_centroids(df, "id", "v", "lab").collect()}
    assert got[0, "a"] == 2.0 and got[4, "a"] == 0.0 and got[3, "b"] == 2.0


def test_confusion_grid_is_full(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "c")], "y string, p string")
    got = {(r["y"], r["p"]): r["n"] for r in counts.confusion_matrix(df, "y", "p").collect()}
    assert len(got) == 9 and got["a", "b"] == 1 and got["a", "a"] == 0


def test_stratified_sample_keeps_rare_classes(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 5, "rare").otherwise("common").alias("y"))
    got = clean.stratified_sample(df, "id", "y", 100).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {"rare": 5, "common": 50}


@pytest.mark.parametrize("small", [True, False])
def test_visits_without_place_or_flag(spark, monkeypatch, small):
    """Places, shares and flags with missing visits, places and flags, with a lookup that is sent and one that is joined."""
    if not small:
        monkeypatch.setattr(joins, "SMALL_ROWS", 0)
    fact = spark.createDataFrame(
        [(1, 10), (1, 10), (1, 20), (1, 30), (2, 30), (2, 40), (3, 20), (3, 99), (3, None), (4, 40), (None, 10), (5, 10), (5, 20)],
        "e long, k long")
    dim = spark.createDataFrame(
        [(10, "City 1", True), (20, "city_2", False), (30, "none", True), (40, None, None)], "k long, p string, f boolean")
    (block,) = events.merchant_blocks(fact, dim, "e", "k", "p", "f", r"city[ _]?(\d+)")
    got = {r[0]: tuple(r)[1:] for r in block.collect()}
    assert got == {1: ("city_01", 2 / 3, 3 / 4), 2: (None, None, 1.0), 3: ("city_02", 1.0, 0.0), 4: (None, None, None),
                   None: ("city_01", 1.0, 1.0), 5: ("city_01", 0.5, 0.5)}
    got = {r[0]: tuple(r)[1:] for r in events.modal_place(fact, dim, "e", "k", "p", "top", "frac").collect()}
    assert got == {1: ("City 1", 0.5), 2: ("none", 1.0), 3: ("city_2", 1.0), None: ("City 1", 1.0), 5: ("City 1", 0.5)}


def test_visits_meet_a_small_lookup_before_any_shuffle(spark, capsys):
    fact = spark.range(1000).selectExpr("id % 7 AS e", "id % 11 AS k")
    dim = spark.range(11).selectExpr("id AS k", "'City ' || id AS p", "id > 5 AS f")
    for df in (events.modal_place(fact, dim, "e", "k", "p", "top"), *events.merchant_blocks(fact, dim, "e", "k", "p", "f", r"City (\d+)")):
        df.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2      # by (entity, place) and by entity
