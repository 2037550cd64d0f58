from pyspark.sql import functions as F

from sigscreen.llm import near
from sigscreen.llm.corpus import identified, reachable


def _docs(spark, n):
    return identified(spark.range(n).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"),
                                            F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))


def test_only_wanted_texts_travel(spark):
    """Every wanted text is kept, those without an id too, and of 20,000 others hardly any."""
    docs = _docs(spark, 20_000)
    wanted = docs.where("fp % 50 = 0").select("did", "fp")
    kept = near._maybe_wanted(docs, wanted)
    assert kept.columns == docs.columns
    n = wanted.count()
    assert kept.join(wanted, ["did", "fp"], "left_semi").count() == n > 300
    assert n <= kept.count() < n + 60
    assert near._maybe_wanted(docs, wanted.limit(0)).count() == 0


def test_a_full_map_lets_all_texts_through(spark, monkeypatch):
    monkeypatch.setattr(near, "BITS", 8)
    docs = _docs(spark, 300)
    assert near._maybe_wanted(docs, docs.select("did", "fp")).count() == 300


def _texts(df):
    return df._jdf.queryExecution().executedPlan().toString(), df._jdf.queryExecution().optimizedPlan().toString()


def test_full_sets_are_not_shuffled(spark, monkeypatch):
    """Texts meet their class before they become sets: no exchange stands above the step that makes them, and repeated rows give one set."""
    reachable(spark)
    docs = _docs(spark, 50)
    classes = docs.where("doc_id % 2 = 0").select("did", "fp").withColumn("c", F.col("did") + 1000)
    want = {r.c for r in classes.collect()}
    with monkeypatch.context() as patch:
        patch.setattr(near, "cut_lineage", lambda df: df)
        plan, _ = _texts(near._sets(classes.select("c"), classes, docs.union(docs), 2))
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and "Exchange" in plan
    got = near._sets(classes.select("c"), classes, docs.union(docs), 2).collect()
    assert sorted(r.c for r in got) == sorted(want) and all(len(r.sketch) == 1 for r in got)


def test_long_columns_join_last_in_blocks(spark, monkeypatch):
    """Rows are dealt into blocks before they get their values, so values don't travel by hub too."""
    rows = spark.range(40).select((F.col("id") % 2).alias("hub"), F.col("id").alias("c"), F.lit(5).cast("long").alias("n"),
                                  F.col("id").alias("comp"), (F.col("id") % 3 == 0).alias("out"))
    values = spark.range(40).select(F.col("id").alias("c"), F.array(F.lit(1)).alias("of"))
    monkeypatch.setattr(near, "cut_lineage", lambda df: df)
    _, plan = _texts(near._blocks(rows, values, near._sketch_flags, "hub long, c long"))
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert ["(c#" in line for line in joins[:2]] == [True, False]
