import pytest
from pyspark.sql import functions as F

from sigscreen import profile
from sigscreen.plans import profile as P
from sigscreen.sources import tables as S


@pytest.mark.parametrize("ref,path", [
    ("telco.messages", False), ("messages", False), ("s3://b/t", True), ("dbfs:/x", True),
    ("/lake/t", True), ("file:/x", True), ("a.csv", True), ("t_*", True), ("x.json", True)])
def test_path_or_name(ref, path):
    assert S.is_path(ref) is path


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", float("nan"))], "i long, s string, d double")
    df.write.json(f"{tmp_path}/t.json")
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    df.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/t.tsv")
    S.write_any(df, f"{tmp_path}/t.parquet")
    for name in ("t.json", "t.csv", "t.tsv", "t.parquet"):
        got = S.read_any(spark, f"{tmp_path}/{name}")
        assert {r["s"] for r in got.collect()} == {"a", "b"}, name
    assert S.read_any(spark, f"{tmp_path}/t.parquet").where("isnan(d)").count() == 1
    assert S.read_any(spark, f"{tmp_path}/t.parquet", nrows=1).count() == 1
    assert S.read_any(spark, f"{tmp_path}/t.csv", fmt="text").columns == ["value"]
    S.write_any(df.limit(1), f"{tmp_path}/t.parquet")       # overwrites
    assert S.read_named(spark, str(tmp_path), "t.parquet").count() == 1


def test_folder_of_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.tsv").write_text("x\ty\n1\t2\n3\t4\n")
    (tmp_path / "notes.txt").write_text("no table")
    got = S.read_folder(spark, [str(tmp_path), f"{tmp_path}/b.csv", "/no/such/place"])
    assert [p.rsplit("/", 1)[1] for p in got] == ["a.parquet", "b.csv", "c.tsv"]
    assert {p.rsplit("/", 1)[1]: d.count() for p, d in got.items()} == {
        "a.parquet": 3, "b.csv": 1, "c.tsv": 2}


def test_folder_name_twice_in_a_path(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/raw/raw/a.parquet")
    assert len(S.read_folder(spark, [f"{tmp_path}/raw/raw"])) == 1


def test_folders_are_listed_without_the_driver_context(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "sparkContext", property(lambda s: pytest.fail("a remote session has no context")))
    spark.range(3).repartition(2).write.parquet(f"{tmp_path}/deep er/a.parquet")
    (tmp_path / "deep er" / "b.json").write_text('{"x": 1}')
    (tmp_path / "deep er" / "empty").mkdir()
    for folder in (f"{tmp_path}/deep er", f"{tmp_path}/deep er/", f"file:{tmp_path}/deep er"):
        assert [p.rsplit("/", 1)[1] for p in S.read_folder(spark, [folder])] == ["a.parquet"]
    assert S.read_folder(spark, [f"{tmp_path}/deep er/empty", f"{tmp_path}/none"]) == {}


def test_written_files_are_in_order(spark, tmp_path):
    df = spark.range(5000).select(F.pmod(F.hash("id"), F.lit(100_000)).alias("id"), F.lit("x").alias("v")).repartition(4)
    S.write_any(df, f"{tmp_path}/sorted.parquet", sort_by="id")
    files = sorted(p for p in (tmp_path / "sorted.parquet").iterdir() if p.suffix == ".parquet")
    ids = [[r["id"] for r in spark.read.parquet(str(p)).collect()] for p in files]
    flat = [i for part in ids for i in part]
    assert flat == sorted(flat) and len(flat) == 5000
    S.write_any(df, f"{tmp_path}/two.parquet", sort_by=["v", "id"])
    assert S.read_any(spark, f"{tmp_path}/two.parquet").count() == 5000


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 1.5)], "i long, d double").write.parquet(f"{tmp_path}/t.parquet")
    plan = S.read_any(spark, f"{tmp_path}/t.parquet").where("d > 1")._jdf.queryExecution().toString()
    assert "GreaterThan(d" in plan


def test_catalog_round_trip(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/shop'")
    try:
        S.write_any(spark.range(4), "shop.things")
        assert S.read_any(spark, "shop.things").count() == 4
        assert S.read_named(spark, "shop", "things").count() == 4
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def _mixed(spark):
    return spark.range(50).select(
        "id", F.when(F.col("id") < 47, F.col("id").cast("string")).alias("holes"),
        F.timestamp_seconds("id").alias("when"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias(
            "day_date"),
        F.concat(F.lit("fact number "), F.col("id").cast("string")).alias("facts"),
        F.array(F.col("id"), F.lit(1)).alias("pair"), (F.col("id") % 5).alias("hits"),
        F.lit(None).cast("string").alias("empty_ts"),
        F.concat(F.lit("x" * 30), F.col("id").cast("string")).alias("long"))


def test_profile_mixed(spark):
    got = {r["column"]: r for r in P.profile_columns({"t": _mixed(spark)}).collect()}
    assert {c for c, r in got.items() if r["is_time"]} == {"when", "day_date"}
    assert {c for c, r in got.items() if r["is_key"]} == {"id", "facts", "long"}
    assert got["holes"]["null_pct"] == 6.0 and not got["holes"]["is_key"]
    assert got["pair"]["cardinality"] == 50 and got["pair"]["dtype"] == "array<bigint>"
    assert got["id"]["samples"] == "0, 1, 10" and got["empty_ts"]["samples"] == "—"
    assert got["long"]["samples"].split(", ") == ["x" * 21 + "..."] * 3
    assert got["long"]["cardinality"] == 50 and got["hits"]["cardinality"] == 5


def test_profile_call(spark, tmp_path):
    _mixed(spark).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(20).write.parquet(f"{tmp_path}/u.parquet")
    out = profile(spark, [f"{tmp_path}/t.parquet", f"{tmp_path}/u.parquet", "/gone/x.parquet"],
                  exact_count=True)
    rows = out["columns"].collect()
    assert [r["error"] is not None for r in rows if r["table"] == "/gone/x.parquet"] == [True]
    keys = out["join_keys"].collect()
    assert [(r["key_column"], len(r["tables"])) for r in keys] == [("id", 2)]
    assert {r["row_count"] for r in out["counts"].collect()} == {50, 20}
    close = {(r["table"][-9:], r["column"]): r["approx_distinct"] for r in out["approx_keys"].collect()}
    assert close["t.parquet", "id"] == pytest.approx(50, rel=0.1)
    assert P.profile_columns({"t": spark.range(9)}, sample=4).first()["row_count"] == 4


def test_containment_finds_renamed_keys(spark):
    people = spark.range(10).withColumnRenamed("id", "person_id")
    edges = spark.range(30).select((F.col("id") % 5).alias("src_id"), (F.col("id") + 5).alias("dst_id"))
    got = {(r["from_key"], r["to_key"]): r["containment"] for r in P.key_containment({
        "p": (people, "person_id"), "s": (edges, "src_id"), "d": (edges, "dst_id")}).collect()}
    assert got["s", "p"] == 1.0 and got["p", "s"] == 0.5 and got["s", "d"] == 0.0
    assert got["d", "p"] == pytest.approx(5 / 30)


def test_containment_of_five_hundred_columns(spark, monkeypatch):
    sets = {f"k{i}": {v + 40 * (i % 50) for v in range(100) if v % (i % 9 + 1) == 0} for i in range(500)}
    rows = spark.createDataFrame([[v + 40 * (i % 50) if v % (i % 9 + 1) == 0 else None for i in range(500)] for v in range(100)],
                                 ", ".join(f"k{i} long" for i in range(500)))
    columns = {f"k{i}": (rows, f"k{i}") for i in range(500)}
    got = {(r["from_key"], r["to_key"]): (r["distinct_from"], r["shared"]) for r in P.key_containment(columns).collect()}
    assert len(got) == 500 * 499
    for a, b in (("k0", "k1"), ("k3", "k400"), ("k17", "k67"), ("k499", "k449"), ("k6", "k56")):
        assert got[a, b] == (len(sets[a]), len(sets[a] & sets[b]))
    monkeypatch.setattr(P, "KEPT", 30)             # sketches far smaller than the columns
    some = {n: columns[n] for n in list(columns)[::10]}
    got = {(r["from_key"], r["to_key"]): r["shared"] for r in P.key_containment(some, 0.6).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a in some for b in some if a != b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a])}
    assert got == want and len(want) > 20
    none = spark.createDataFrame([(None,)], "k string")
    assert [(r["shared"], r["containment"]) for r in P.key_containment({"a": (none, "k"), "b": (none, "k")}).collect()] == [(0, None)] * 2


def test_sketches_of_parts_unite(spark):
    parts = [spark.range(lo, hi).select("id", (F.col("id") % 7).cast("string").alias("few"), F.lit(None).cast("int").alias("none"))
             for lo, hi in ((0, 6000), (4000, 12_000))]
    stored = P.distinct_sketches(parts[0], ["id", "few", "none"], "a").unionByName(P.distinct_sketches(parts[1], ["id", "few", "none"], "b"))
    got = {r["column"]: r for r in P.united_distinct(stored).collect()}
    assert got["id"]["approx_distinct"] == pytest.approx(12_000, rel=0.05) and got["id"]["rows"] == 14_000
    assert got["few"]["approx_distinct"] == 7 and got["none"]["approx_distinct"] == 0 and got["none"]["nulls"] == 14_000


def test_a_sample_has_its_size_and_repeats(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 50).alias("v"))
    first = sorted(r["id"] for r in P.random_sample(df, 700).collect())
    assert len(first) == 700 == len(set(first))
    assert first == sorted(r["id"] for r in P.random_sample(df.repartition(9), 700).collect())
    assert first != sorted(r["id"] for r in P.random_sample(df, 700, seed=1).collect())
    assert 250 < sum(i < 2500 for i in first) < 450                     # not the first rows
    assert P.random_sample(df, 9000).count() == 5000
    repeated = df.select(F.lit(1).alias("x"))
    assert P.random_sample(repeated, 30).count() == 30
