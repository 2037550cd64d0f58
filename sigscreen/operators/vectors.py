"""Distances to class centroids, with each row's own fold left out of the centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.operators.folds import UNLABELED

MAX_BROADCAST_NUMBERS = 4_000_000    # 32 MB of doubles


def fold_centroids(df: DataFrame, vector: str, label: str, fold: str = "fold") -> DataFrame:
    """(fold, label, n, centroid): the class mean over all other folds; -1 leaves out none.

    Sums are kept per (class, fold, dimension), so the work per row is additive and a
    class that holds most rows is summed before the shuffle.
    """
    if fold not in df.columns:
        raise ValueError("labels are only read together with folds")
    known = df.where(F.col(label).isNotNull() & (F.col(fold) != UNLABELED))
    cells = known.select(label, F.col(fold).alias("_f"), F.posexplode(vector).alias("dim", "x"))
    sums = cells.groupBy(label, "dim", "_f").agg(
        F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n"))
    folds = sorted({r[0] for r in known.select(fold).distinct().collect()})
    runs = [UNLABELED, *folds]
    spread = sums.withColumn(fold, F.explode(F.array(*[F.lit(r) for r in runs])))
    others = spread.where(F.col(fold) != F.col("_f")).groupBy(fold, label, "dim").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"))
    return others.groupBy(fold, label).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("n")).alias(
            "m")))), lambda c: c["m"]).alias("centroid"))


def oof_centroids(df: DataFrame, id_col: str, vector: str, label: str,
                  fold: str = "fold") -> DataFrame:
    """(id, label, distance): Euclidean distance to each class centroid of the other folds."""
    centers = fold_centroids(df, vector, label, fold)
    size = centers.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size <= MAX_BROADCAST_NUMBERS:
        centers = F.broadcast(centers)
        rows = df.select(id_col, fold, vector)
        joined = rows.join(centers.withColumnRenamed(label, "_class"), fold)
    else:
        # Folds are few and large keys: spread the rows and repeat the centroids.
        salts = 64
        rows = df.select(id_col, fold, vector,
                         F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt"))
        copies = centers.withColumnRenamed(label, "_class").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        joined = rows.join(copies, [fold, "_salt"])
    square = F.aggregate(
        F.zip_with(vector, "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
        F.lit(0.0), lambda acc, d: acc + d)
    return joined.select(id_col, F.col("_class").alias(label), F.sqrt(square).alias("distance"))
