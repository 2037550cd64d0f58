from pyspark.sql import functions as F

from sigscreen.operators import ranks


def test_auc_of_more_rows_than_a_long_can_square(spark, monkeypatch):
    counts = spark.createDataFrame([("f", 1.0, "a", 4 * 10**9), ("f", 2.0, "b", 4 * 10**9)],
                                   "feature string, x double, y string, n long")
    first = {"a": 4e9 * (4e9 + 1) / 2 / 4e9, "b": 4e9 + (4e9 + 1) / 2}
    monkeypatch.setattr(ranks, "Splits", lambda *a: None)
    monkeypatch.setattr(ranks, "midranks", lambda *a: counts.withColumn(
        "rank", F.when(F.col("y") == "a", first["a"]).otherwise(first["b"])).withColumn("_all", F.lit(8 * 10**9)))

    class Cells:
        def where(self, _):
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return counts

    got = {r["y"]: r["auc"] for r in ranks.class_auc(Cells()).collect()}
    assert got["a"] < 1e-6 and got["b"] > 1 - 1e-6
