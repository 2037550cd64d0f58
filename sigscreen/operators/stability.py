"""Signal over time: equal-frequency slices, and how much MI varies between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import to_time
from sigscreen.operators.information import (
    binned_counts, category_counts, impute_median, mi_discrete, mi_numeric, numeric_cells)
from sigscreen.operators.ordering import value_positions
from sigscreen.runtime import cut_lineage

MIN_SLICE_ROWS = 50


def time_slices(df: DataFrame, id_col: str, ts: str, slices: int = 4,
                name: str = "slice") -> DataFrame:
    """Add an equal-frequency slice number by time; rows without a time are left out.

    The cut points are quantiles of the row number, so the outer slices take the odd
    rows (2, 1, 1, 2 of six), unlike ``ntile``.
    """
    rows = df.withColumn("_t", F.unix_micros(to_time(ts, df.schema[ts].dataType))).where(
        "_t is not null")
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_one"))
    placed = value_positions(rows, "_t", [id_col], name="_pos").withColumn("_one", F.lit(0))
    placed = placed.join(F.broadcast(total), "_one")     # one row
    at = F.ceil(F.try_divide((F.col("_pos") - 1) * slices, F.col("_n") - 1)) - 1
    return placed.withColumn(name, F.greatest(F.lit(0), at).cast("int")).select(*df.columns, name)


def slice_mi(df: DataFrame, id_col: str, label: str, ts: str, numeric: Sequence[str],
             categorical: Sequence[str], slices: int = 4, estimator: str = "knn",
             min_rows: int = MIN_SLICE_ROWS) -> DataFrame:
    """(slice, feature, mi) of the slices with enough rows and two classes; medians per slice."""
    cut = cut_lineage(time_slices(
        df.select(id_col, label, ts, *numeric, *categorical), id_col, ts, slices))
    good = cut.groupBy("slice", label).agg(F.count(F.lit(1)).alias("n")).groupBy("slice").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).where(
        f"n >= {min_rows} and c >= 2").select("slice")
    cut = cut.join(F.broadcast(good), "slice")      # at most one row per slice
    parts = []
    if categorical:
        parts.append(mi_discrete(category_counts(cut, label, categorical, ["slice"]), ["slice"]))
    if numeric:
        # split points, class sizes and both searches read the filled cells
        cells = cut_lineage(impute_median(numeric_cells(cut, id_col, label, numeric, ["slice"]), ["slice"]))
        parts.append(mi_numeric(cells, ["slice"], parts=slices) if estimator == "knn"
                     else mi_discrete(binned_counts(cells, ["slice"]), ["slice"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stability_cv(mi: DataFrame) -> DataFrame:
    """(feature, stability_cv): |deviation / mean| of MI over slices, from two slices up."""
    cv = F.abs(F.stddev_samp("mi") / (F.avg("mi") + 1e-9))
    return mi.groupBy("feature").agg(
        cv.alias("stability_cv"), F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
