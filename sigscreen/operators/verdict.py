"""Verdict rules, the summary row, and the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.operators.ordering import exact_quantiles


@dataclass(frozen=True)
class Thresholds:
    """Limits of the verdict rules; a person may move them."""

    min_coverage: float = 0.2
    max_auc: float = 0.97
    max_mi_ratio: float = 0.80
    max_spearman: float = 0.9
    max_cv: float = 1.0
    weak_factor: float = 1.5


# Output columns in order, and the reason of each rule.
VERDICT_COLUMNS = (
    "feature", "recommend", "reason", "mi", "mi_ratio", "null_p95", "beats_null",
    "best_auc", "importance", "coverage", "stability_cv",
)
NO_SIGNAL = "no signal over null"
TOO_SPARSE = "too sparse"
TOO_STRONG = "suspiciously strong — check leakage"
EXPLAINS_LABEL = "explains most of the label — check leakage"
UNSTABLE = "unstable over time"
WEAK = "weak incremental value"
KEEP = "beats null, contributes in model"


def verdicts(stats: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add ``beats_null``, ``recommend`` and ``reason``; the first rule that applies wins.

    ``stats`` has feature, mi, mi_ratio, null_p95, best_auc, importance, coverage,
    stability_cv and redundant_with. A missing statistic triggers no rule, except that a
    missing importance counts as 0, and a missing MI does not beat the null.
    """
    importance = F.coalesce(F.col("importance"), F.lit(0.0))
    rules = [
        (F.coalesce(F.col("mi") <= F.col("null_p95"), F.col("mi").isNull()), "drop", F.lit(NO_SIGNAL)),
        (F.col("coverage") < limits.min_coverage, "drop", F.lit(TOO_SPARSE)),
        (F.col("best_auc") > limits.max_auc, "investigate", F.lit(TOO_STRONG)),
        (F.col("mi_ratio") > limits.max_mi_ratio, "investigate", F.lit(EXPLAINS_LABEL)),
        (F.col("redundant_with").isNotNull(), "investigate",
         F.concat(F.lit("redundant with "), F.col("redundant_with"))),
        (F.col("stability_cv") > limits.max_cv, "investigate", F.lit(UNSTABLE)),
        ((importance <= 0) & (F.col("mi") < F.col("null_p95") * limits.weak_factor),
         "investigate", F.lit(WEAK)),
    ]
    chosen = F.lit(None)
    for test, recommend, reason in reversed([*rules, (F.lit(True), "keep", F.lit(KEEP))]):
        chosen = F.when(test, F.struct(F.lit(recommend).alias("recommend"),
                                       reason.alias("reason"))).otherwise(chosen)
    return stats.withColumns({
        "beats_null": F.when(F.col("mi").isNull(), False).otherwise(F.col("mi") > F.col("null_p95")), "importance": importance, "_v": chosen,
    }).withColumns({"recommend": F.col("_v.recommend"), "reason": F.col("_v.reason")}).select(
        *VERDICT_COLUMNS, "redundant_with")


def report_order(table: DataFrame) -> DataFrame:
    """Verdict columns, by recommendation and then the highest MI; one row per feature."""
    return table.select(*VERDICT_COLUMNS).orderBy("recommend", F.desc("mi"), "feature")


def verdict_counts(table: DataFrame) -> DataFrame:
    def n(kind: str):
        return F.count(F.when(F.col("recommend") == kind, F.lit(1))).alias(kind)

    return table.agg(F.count(F.lit(1)).alias("features"), n("keep"), n("investigate"), n("drop"))


def class_quartiles(cells: DataFrame, groups: Sequence[str] = ("feature", "y")) -> DataFrame:
    """(feature, y, q25, q50, q75): exact quartiles of each feature within each class."""
    return exact_quantiles(cells, groups, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
