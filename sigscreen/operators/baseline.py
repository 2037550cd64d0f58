"""Baseline model: out-of-fold predictions, macro scores, permutation importance.

``boosted`` is multiclass gradient boosting on Spark aggregates (``operators.boosting``), for any number of category levels.
``forest`` and ``gbt`` are MLlib's, whose nominal columns are bounded by ``levels``; a category with more of them enters
as a continuous code there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.operators import boosting
from sigscreen.operators.folds import holdout
from sigscreen.operators.ordering import hash_positions
from sigscreen.operators.ranks import class_auc
from sigscreen.runtime import cut_lineage, side_by_side

LEVELS = 255      # levels of a nominal column for MLlib's trees


def assemble(encoded: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
             keep: Sequence[str], levels: int = LEVELS) -> tuple[DataFrame, list[str]]:
    """(keep..., y, features) and the class names; numbers come before the codes of categories.

    A code with up to ``levels`` values is marked as nominal for MLlib; the boosted model takes all codes as categories.
    A row's scores are an array with a number per class, so classes are read by name to the driver.
    """
    classes = [r[0] for r in encoded.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
    index = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])
    y = F.try_element_at(index, F.col(label).cast("string")).alias(
        "y", metadata={"ml_attr": {"type": "nominal", "name": "y", "vals": classes}})
    highest = {}
    if categorical:
        highest = encoded.agg(*[F.max(c).alias(c) for c in categorical]).first().asDict()
    inputs = []
    for c in [*numeric, *categorical]:
        arity = int(highest.get(c) or 0) + 1
        nominal = c in highest and 1 < arity <= levels
        meta = {"ml_attr": {"type": "nominal", "name": c, "num_vals": arity}} if nominal else {
            "ml_attr": {"type": "numeric", "name": c}}
        inputs.append(F.col(c).cast("double").alias(c, metadata=meta))
    rows = encoded.select(*keep, y, *inputs)
    rows = VectorAssembler(inputCols=[*numeric, *categorical], outputCol="features",
                           handleInvalid="keep").transform(rows)
    return rows.select(*keep, "y", "features"), classes


def estimator(model: str = "forest", trees: int = 40, depth: int = 6, seed: int = 0):
    """``forest``, or ``gbt``: boosted trees of depth 4, one against the rest."""
    if model == "gbt":
        gbt = GBTClassifier(labelCol="y", maxDepth=4, maxIter=trees, maxBins=LEVELS + 1,
                            seed=seed)
        return OneVsRest(classifier=gbt, labelCol="y")
    return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth,
                                  maxBins=LEVELS + 1, seed=seed)


def _score_column(df: DataFrame) -> str:
    return "probability" if "probability" in df.columns else "rawPrediction"


def out_of_fold(rows: DataFrame, fold: str = "fold", model: str = "forest", numeric: int = 0,
                **settings) -> DataFrame:
    """(id, y, prediction, scores) with every row predicted by a model that never saw its fold.

    ``numeric`` is how many features are numbers; the boosted model takes the others as categories, and grows the trees
    of all folds together.
    """
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    if model == "boosted":
        place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)) - 1
        trees, scored = boosting.fit(rows.select("id", "y", "features", place.cast("int").alias("_fold")), numeric, "_fold",
                                     boosting.Settings(**settings))
        own = scored.withColumn("_s", F.slice("scores", F.col("held") * trees.classes + 1, F.lit(trees.classes)))
        return own.select("id", F.col("y").cast("double").alias("y"),
                          (F.array_position("_s", F.array_max("_s")) - 1).cast("double").alias("prediction"),
                          boosting.probabilities("_s", trees.classes).alias("scores"))

    def predicted(f: int) -> DataFrame:
        fit = estimator(model, **settings).fit(rows.where(F.col(fold) != f))
        done = fit.transform(rows.where(F.col(fold) == f))
        return done.select("id", "y", "prediction", vector_to_array(
            _score_column(done)).alias("scores"))

    parts = side_by_side(rows.sparkSession, [lambda f=f: predicted(f) for f in folds])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def macro_f1(counts: DataFrame, label: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean F1 over all classes seen as label or prediction, from (label, predicted, n)."""
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    ends = F.explode(F.array(
        F.struct(F.col(label).alias("c"), F.col("n").alias("n"), (hit * 2).alias("tp2")),
        F.struct(F.col(predicted).alias("c"), F.col("n").alias("n"), F.lit(0).cast("bigint").alias("tp2"))))
    per = counts.select(*groups, ends.alias("_e")).groupBy(*groups, "_e.c").agg(
        (F.sum("_e.tp2") / F.sum("_e.n")).alias("f1"))
    return per.groupBy(*groups).agg(F.avg("f1").alias("macro_f1"))


def macro_auc(predictions: DataFrame, label: str = "y", scores: str = "scores") -> DataFrame:
    """One row: mean over classes of the one-vs-rest AUC of the class's score; null if a class has none."""
    cells = predictions.select(label, F.posexplode(scores).alias("c", "x")).select(
        F.col("c").alias("feature"), "x",
        (F.col("c") == F.col(label)).cast("string").alias("y"))
    per = class_auc(cells).where("y = 'true'")
    return per.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("macro_auc"))


def permutation_importance(rows: DataFrame, names: Sequence[str], model: str = "forest",
                           repeats: int = 5, seed: int = 0, numeric: int = 0, **settings) -> DataFrame:
    """(feature, importance): mean drop in macro-F1 on a 30 % holdout when a feature is shuffled.

    In each repeat every holdout row gets a donor row, by joining two hash orders of the
    holdout on position. A feature is shuffled by taking it from the donor, so one join
    and one pass of the model serve all features.
    """
    split = cut_lineage(holdout(rows.select("id", "y", "features"), "id", "y", 0.3, seed))
    if model == "boosted":
        trees = boosting.fit(split.where("not is_test"), numeric, None, boosting.Settings(**settings))[0]

        def predicted(frame: DataFrame) -> DataFrame:
            return boosting.predict(trees, frame, [c for c in frame.columns if c != "features"])
    else:
        predicted = estimator(model, seed=seed, **settings).fit(split.where("not is_test")).transform
    test = split.where("is_test").select("id", "y", vector_to_array("features").alias("v"))
    base = predicted(test.select("y", array_to_vector("v").alias("features"))).groupBy(
        "y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    full = macro_f1(base, "y", "prediction").first()["macro_f1"]

    repeat = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("r")
    places = hash_positions(test.select("id", "y", "v", repeat), ["id"], ["r"], f"{seed}.place")
    donors = hash_positions(test.select("id", F.col("v").alias("d"), repeat), ["id", "r"], ["r"],
                            f"{seed}.donor").drop("id")
    each = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j")
    mixed = places.join(donors, ["r", "pos"]).select("r", "y", "v", "d", each).select(
        "r", "y", "j", array_to_vector(F.transform("v", lambda x, i: F.when(
            i == F.col("j"), F.get("d", F.col("j"))).otherwise(x))).alias("features"))
    counts = predicted(mixed).groupBy("r", "j", "y", "prediction").agg(
        F.count(F.lit(1)).alias("n"))
    drops = macro_f1(counts, "y", "prediction", ["r", "j"]).groupBy("j").agg(
        (F.lit(full) - F.avg("macro_f1")).alias("importance"))
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("j"))
    return drops.select(feature.alias("feature"), "importance")
