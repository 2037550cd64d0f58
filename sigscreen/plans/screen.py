"""Screen features for signal about a multiclass label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import clean_nan, to_time
from sigscreen.operators import baseline as B
from sigscreen.operators import information as I
from sigscreen.operators import ranks as R
from sigscreen.operators.clean import dedup_key, stratified_sample
from sigscreen.operators.counts import confusion_matrix, coverage, label_entropy, top_k
from sigscreen.operators.folds import group_folds, stratified_folds
from sigscreen.operators.joins import lookup_join
from sigscreen.operators.ordering import hash_positions
from sigscreen.operators.stability import slice_mi, stability_cv
from sigscreen.operators.verdict import (
    Thresholds, class_quartiles, report_order, verdict_counts, verdicts)
from sigscreen.runtime import cut_lineage, side_by_side

ROW = "_row"


@dataclass
class Screen:
    """Verdicts (one row per feature), a one-row summary, and chart tables."""

    verdicts: DataFrame
    summary: DataFrame
    charts: dict[str, DataFrame] = field(default_factory=dict)


def labeled_features(features: DataFrame, labels: DataFrame, id_col: str,
                     label: str) -> DataFrame:
    """Feature rows with a label; each id has one label, the smallest if it is given several."""
    one = dedup_key(labels.select(id_col, label).where(F.col(label).isNotNull()), [id_col], [label])
    return lookup_join(features, one, id_col, "inner")


def _roles(df: DataFrame, id_col: str, label: str, time_col: str | None, group_col: str | None,
           include: Sequence[str] | None, exclude: Sequence[str]) -> list[str]:
    if group_col == label:
        raise ValueError("the group column must not be the label")
    if include and label in include:
        raise ValueError("the label cannot be a feature")
    reserved = {id_col, label, time_col, group_col, *exclude}
    cols = list(include) if include else list(df.columns)
    cols = [c for c in cols if c not in reserved]
    if not cols:
        raise ValueError("no feature columns found")
    return cols


def _with_row_key(rows: DataFrame, id_col: str) -> DataFrame:
    """Add a text key that is unique per row: the id, numbered where it occurs more than once."""
    most = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if not most or most == 1:
        return rows.withColumn(ROW, F.col(id_col).cast("string"))
    content = F.md5(F.to_json(F.struct(*rows.columns)))
    numbered = hash_positions(rows.withColumn("_c", content), ["_c"], [id_col], 0, "_n")
    return numbered.withColumn(ROW, F.concat_ws("#", id_col, "_n")).drop("_c", "_n")


def _outer(frames: Sequence[DataFrame]) -> DataFrame:
    """Join small per-feature tables; the first one has every feature."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f), "feature", "left")    # one row per feature
    return out


def _baseline(filled: DataFrame, id_col: str, label: str, group: str | None, numeric: list[str],
              categorical: list[str], model: str, seed: int, settings: dict):
    """(importance per feature, confusion matrix, macro-F1, macro-AUC) of the baseline model."""
    if group:
        dealt = group_folds(filled, group).drop("n")
        folded = lookup_join(filled, dealt, group, "inner").drop(group)
    else:
        dealt = stratified_folds(filled, id_col, label, 5, seed).drop(label)
        folded = filled.join(dealt, id_col)
    data, classes = B.assemble(folded.withColumnRenamed(id_col, "id"), label, numeric, categorical,
                               ["id", "fold"])
    data = cut_lineage(data)

    def folds():
        fixed = {} if model == "boosted" else {"seed": seed}           # boosting draws nothing at random
        oof = cut_lineage(B.out_of_fold(data, "fold", model, len(numeric), **fixed, **settings))
        counts = oof.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))
        names = F.array(*[F.lit(c) for c in classes])
        confusion = confusion_matrix(oof.select(
            F.get(names, F.col("y").cast("int")).alias("label"),
            F.get(names, F.col("prediction").cast("int")).alias("predicted")),
            "label", "predicted")
        return (confusion, B.macro_f1(counts, "y", "prediction").first()["macro_f1"],
                B.macro_auc(oof).first()["macro_auc"])

    def importance():
        return cut_lineage(B.permutation_importance(data, [*numeric, *categorical], model, seed=seed,
                                                    numeric=len(numeric), **settings))

    (confusion, f1, auc), scores = side_by_side(data.sparkSession, [folds, importance])
    return scores, confusion, f1, auc


def screen(features: DataFrame, labels: DataFrame, id_col: str, label_col: str,
           time_col: str | None = None, group_col: str | None = None, sample: int | None = None,
           n_perm: int = 30, include: Sequence[str] | None = None, exclude: Sequence[str] = (),
           thresholds: Thresholds = Thresholds(), seed: int = 0, estimator: str = "knn",
           model: str | None = "forest", charts: bool = True, **model_settings) -> Screen:
    """Judge every feature column: keep, investigate or drop.

    All rows are used unless ``sample`` asks for a stratified sample of about that many.
    ``estimator`` is "knn" or "binned", whatever the size; MI and its null always use the same one.
    ``model`` is "forest", "boosted", "gbt" or None for no baseline; ``model_settings`` go to it.
    """
    rows = labeled_features(clean_nan(features), labels, id_col, label_col)
    cols = _roles(rows, id_col, label_col, time_col, group_col, include, exclude)
    extra = [c for c in {time_col, group_col} if c and c != id_col]
    rows = rows.select(id_col, label_col, *extra, *cols)
    if sample:
        rows = stratified_sample(rows, id_col, label_col, sample, seed)
    # Every statistic below reads these rows, so they are written once.
    rows = cut_lineage(_with_row_key(rows, id_col))
    if group_col != id_col:
        rows = rows.drop(id_col)
    id_col = ROW
    facts = label_entropy(rows, label_col).first()
    if facts["classes"] < 2:
        raise ValueError("the label has fewer than 2 classes")
    numeric, categorical = I.split_kinds(rows, cols)

    # Codes serve as categories for MI too: a missing value is code 0, its own category.
    filled = cut_lineage(I.encode_features(rows, id_col, numeric, categorical,
                                           [label_col, *([group_col] if group_col else [])]))

    spark = rows.sparkSession

    def empty(columns: str) -> DataFrame:
        return spark.createDataFrame([], columns)

    def information() -> DataFrame:
        parts = []
        if categorical:
            parts.append(I.mi_discrete(I.category_counts(filled, label_col, categorical)))
        if numeric:
            cells = I.numeric_cells(filled, id_col, label_col, numeric)
            parts.append(I.mi_numeric(cells) if estimator == "knn"
                         else I.mi_discrete(I.binned_counts(cells)))
        mi = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return cut_lineage(mi.withColumn("mi_ratio", F.col("mi") / F.lit(facts["entropy"])))

    def null() -> DataFrame:
        if n_perm <= 0:
            return spark.createDataFrame([(c, 0.0) for c in cols], "feature string, null_p95 double")
        return cut_lineage(I.null_p95(I.permutation_mi(
            filled, id_col, label_col, numeric, categorical, n_perm, seed, estimator)))

    def auc() -> DataFrame:
        if not numeric:
            return empty("feature string, best_auc double")
        return cut_lineage(R.best_ovr_auc(I.numeric_cells(rows, id_col, label_col, numeric)))

    def redundancy() -> tuple[DataFrame, DataFrame | None]:
        if len(numeric) < 2:
            return empty("feature string, redundant_with string"), None
        pairs = cut_lineage(R.spearman_pairs(rows, id_col, numeric))
        return R.spearman_redundancy(pairs, thresholds.max_spearman).drop("rho"), pairs

    def stable() -> DataFrame:
        dated = 0.0
        if time_col:
            known = to_time(time_col, rows.schema[time_col].dataType).isNotNull()
            dated = rows.agg(F.avg(known.cast("double"))).first()[0] or 0.0
        if dated < 0.5:
            return empty("feature string, stability_cv double")
        return cut_lineage(stability_cv(slice_mi(
            rows, id_col, label_col, time_col, numeric, categorical, estimator=estimator)))

    def baseline() -> tuple[DataFrame, DataFrame | None, float | None, float | None]:
        if not model:
            return empty("feature string, importance double"), None, None, None
        return _baseline(filled, id_col, label_col, group_col, numeric, categorical, model, seed,
                         model_settings)

    mi, p95, aucs, (redundant, rank_pairs), cv, (importance, confusion, f1, macro_auc) = \
        side_by_side(spark, [information, null, auc, redundancy, stable, baseline])
    # every feature has a row: one of which no class keeps two rows has no estimate, and counts as MI 0
    every = spark.createDataFrame([(c,) for c in cols], "feature string")
    stats = _outer([every, mi, p95, coverage(rows, cols), aucs, redundant, cv, importance]).withColumns({
        "null_p95": F.when(F.col("mi").isNull(), F.coalesce("null_p95", F.lit(0.0))).otherwise(F.col("null_p95")),
        "mi_ratio": F.when(F.col("mi").isNull(), F.lit(0.0)).otherwise(F.col("mi_ratio")),
        "mi": F.coalesce("mi", F.lit(0.0))})

    table = cut_lineage(verdicts(stats, thresholds))
    summary = verdict_counts(table).select(
        F.lit(facts["rows"]).cast("bigint").alias("sample_rows"),
        F.lit(facts["classes"]).cast("bigint").alias("classes"),
        F.col("features"),
        F.lit(f1).cast("double").alias("macro_f1"),
        F.lit(macro_auc).cast("double").alias("macro_auc"),
        "keep", "investigate", "drop")
    out = Screen(report_order(table), summary)
    if charts:
        out.charts["mi_top"] = top_k(table.select("feature", "mi"), "mi", 20, "feature")
        if model:
            out.charts["importance_top"] = top_k(
                table.select("feature", "importance"), "importance", 20, "feature")
            out.charts["confusion"] = confusion
        best = [r["feature"] for r in top_k(table, "mi", 4, "feature").collect()]
        shown = [c for c in best if c in numeric]
        if shown:
            out.charts["class_quartiles"] = class_quartiles(
                I.numeric_cells(rows, id_col, label_col, shown))
        if rank_pairs is not None:
            out.charts["spearman"] = rank_pairs
    return out


def rescreen_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(feature, before, after, mi_before, mi_after) of two verdict tables; cut features have no after."""
    left = before.select("feature", F.col("recommend").alias("before"), F.col("mi").alias("mi_before"))
    right = after.select("feature", F.col("recommend").alias("after"), F.col("mi").alias("mi_after"))
    return left.join(right, "feature", "left").select(
        "feature", "before", "after", "mi_before", "mi_after")
