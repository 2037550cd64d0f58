"""Gradient boosting for any number of classes and category levels, as Spark aggregates.

A round grows one tree per class, and all models asked for (one per left-out fold, say) grow together. A level of all these trees is one
pass over the rows and one ``groupBy(tree, node, feature, bin)`` of gradient sums, combined before the shuffle, so what travels are
sums, never rows. A number enters as the quantile bin it lies in. The categories of a node are put in the order of
their gradient ratio, so a cut in that order is the best two-way split of them, however many there are; no level is
dropped or read as a number. Rows are never shuffled: they learn their side from the cuts, which are a few numbers per
tree, and from a lookup by category.

Everything is decided by sums rounded to ``DIGITS`` places and ties by fixed rules, so a fit repeats.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscreen.operators.joins import SMALL_BYTES, hot_keys, lookup_join
from sigscreen.operators.ordering import ROWS_PER_BUCKET, Splits, exact_quantiles, running_weights
from sigscreen.runtime import cut_lineage

DIGITS = 9             # places of a gain or an order that count


@dataclass
class Settings:
    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 32         # of a number
    l2: float = 1.0        # added to the curvature of a node
    smooth: float = 10.0   # added to that of a category before categories are put in order
    min_rows: int = 20     # on either side of a cut


@dataclass
class Boosted:
    """The trees of all models: tree t of a round belongs to model t div classes and class t mod classes."""

    classes: int
    models: int
    numeric: int               # features before this one are numbers
    settings: Settings
    edges: list[list[float]]   # of each number
    start: list[float]         # the first score of each tree
    rounds: list[tuple[list[int], list[int], list[float]]] = field(default_factory=list)   # (feature, cut, leaf) by tree and node
    sides: list[DataFrame] = field(default_factory=list)    # (round, feature, bin, i): categories that go right at node i
    levels: list[int] = field(default_factory=list)         # highest code of each category column

    @property
    def trees(self) -> int:
        return self.classes * self.models

    @property
    def nodes(self) -> int:
        return 2 ** self.settings.depth


def _beside(rows: DataFrame, **arrays) -> DataFrame:
    """Rows with the same arrays in each: a table of one row, sent to all."""
    kinds = {int: "array<int>", float: "array<double>", list: "array<array<double>>"}
    schema = "_one int, " + ", ".join(f"{k} {kinds[type(v[0])] if v else 'array<array<double>>'}" for k, v in arrays.items())
    one = rows.sparkSession.createDataFrame([(0, *arrays.values())], schema)
    return rows.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")


def _binned(rows: DataFrame, keep: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """(keep..., x): the bin of each number and the code of each category."""
    x = F.transform("_v", lambda v, i: F.when(i < len(edges), F.size(F.filter(F.get("edges", i), lambda e: e < v))).otherwise(v).cast("int"))
    return _beside(rows.withColumn("_v", vector_to_array("features")), edges=edges).select(*keep, x.alias("x"))


def _node(model: Boosted, deep: int, at: str) -> str:
    """The node, numbered as in a heap, that a row has reached ``deep`` levels down; ``at`` is where the tree's nodes begin in the arrays."""
    i = f"{at} + node"
    right = (f"CASE WHEN feature[{i}] < 0 THEN false WHEN feature[{i}] < {model.numeric} THEN x[feature[{i}]] > cut[{i}] "
             f"ELSE array_contains(rights[feature[{i}] - {model.numeric}], {i}) END")
    return f"aggregate(sequence(1, {deep}), 1, (node, level) -> 2 * node + int({right}))" if deep else "1"


def _with_rights(rows: DataFrame, model: Boosted, sides: DataFrame | None, used: Sequence[int], entries: int, hot: dict[int, list]) -> DataFrame:
    """Add ``rights``: for each category column the nodes at which the row's category goes right."""
    nothing = "CAST(array() AS array<int>)"
    for f in used:
        lookup = sides.where(F.col("feature") == f).groupBy(F.col("bin").alias(f"_code{f}")).agg(F.collect_set("i").alias(f"_r{f}"))
        rows = rows.withColumn(f"_code{f}", F.get("x", F.lit(f)))
        if (model.levels[f - model.numeric] + 1) * (16 + 4 * entries) <= SMALL_BYTES:      # a bound on what the lookup can hold
            rows = rows.join(F.broadcast(lookup), f"_code{f}", "left")
        else:
            rows = lookup_join(rows, lookup, f"_code{f}", "left", hot.get(f))
    lists = [f"coalesce(_r{f}, {nothing})" if f in used else nothing for f in range(model.numeric, model.numeric + len(model.levels))]
    rows = rows.withColumn("rights", F.expr(f"array({', '.join(lists)})" if lists else "CAST(array() AS array<array<int>>)"))
    return rows.drop(*[c for f in used for c in (f"_code{f}", f"_r{f}")])


def _gradients(rows: DataFrame, model: Boosted) -> DataFrame:
    """Add g and h of every tree: the softmax of its model's scores less the label, and its curvature."""
    k, last = model.classes, model.models - 1
    top = f"transform(sequence(0, {last}), m -> array_max(slice(scores, m * {k} + 1, {k})))"
    total = (f"transform(sequence(0, {last}), m -> aggregate(slice(scores, m * {k} + 1, {k}), 0D, "
             f"(a, s) -> a + exp(s - _top[m])))")
    p = f"transform(scores, (s, t) -> exp(s - _top[t div {k}]) / _total[t div {k}])"
    return rows.withColumn("_top", F.expr(top)).withColumn("_total", F.expr(total)).withColumn("_p", F.expr(p)).withColumns({
        "g": F.expr(f"transform(_p, (p, t) -> p - int(t % {k} = y))"), "h": F.expr("transform(_p, p -> p * (1 - p))")}).drop("_top", "_total", "_p")


def _best_cuts(stats: DataFrame, settings: Settings, wide: bool) -> DataFrame:
    """(t, node, feature, place, bin, gain) of each node that is worth a cut: what comes after (place, bin) goes right."""
    keys = ["t", "node", "feature"]
    if wide:          # some feature has more bins than a window should hold
        at = F.struct("place", "bin")
        splits = Splits(stats, keys, "place")
        run = stats
        for c in ("n", "g", "h"):
            run = running_weights(run, "place", c, keys, splits, f"_{c}", total=f"all_{c}", then=["bin"])
            run = run.withColumn(f"left_{c}", F.col(f"_{c}") + F.col(c)).drop(f"_{c}")
    else:
        order = Window.partitionBy(*keys).orderBy("place", "bin")
        whole = Window.partitionBy(*keys)
        at = F.struct("place", "bin")
        run = stats.select("*", *[F.sum(c).over(order).alias(f"left_{c}") for c in ("g", "h", "n")],
                           *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("g", "h", "n")])

    def worth(g, h):
        return g * g / (h + settings.l2)

    right_g, right_h = (F.col(f"all_{c}") - F.col(f"left_{c}") for c in ("g", "h"))
    gain = worth(F.col("left_g"), F.col("left_h")) + worth(right_g, right_h) - worth(F.col("all_g"), F.col("all_h"))
    able = run.withColumn("gain", F.round(gain, DIGITS)).where(
        (F.col("gain") > 0) & (F.col("left_n") >= settings.min_rows) & (F.col("all_n") - F.col("left_n") >= settings.min_rows))
    first = F.struct(-F.col("gain"), "feature", at)
    return able.groupBy("t", "node").agg(F.min_by(F.struct("feature", "place", "bin", "gain"), first).alias("_c")).select("t", "node", "_c.*")


def fit(rows: DataFrame, numeric: int, held: str | None = None, settings: Settings = Settings()) -> tuple[Boosted, DataFrame]:
    """Trees for rows (id, y, features), and the rows with the scores of all models, (id, y, held, x, scores).

    ``features`` is a vector whose first ``numeric`` entries are numbers and whose others are codes of categories from 0;
    ``y`` is the number of the class. Model m learns from the rows whose ``held`` is not m; a row with -1 is learned by all. Without
    the column there is one model that learns from all rows. A node whose best cut gains nothing stays whole.
    """
    spark, s = rows.sparkSession, settings
    rows = rows.withColumn("_held", F.col(held).cast("int") if held else F.lit(-1))
    seen = rows.groupBy("_held", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()   # models x classes numbers
    classes, models = 1 + max((r["y"] for r in seen), default=0), 1 + max((r["_held"] for r in seen if r["_held"] > 0), default=0)
    size = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    size = size["n"] if size else numeric
    number = [[0] * classes for _ in range(models)]
    for r in seen:
        for m in range(models):
            number[m][r["y"]] += r["n"] * (m != r["_held"])
    start = [math.log((n + 1) / (sum(own) + classes)) for own in number for n in own]
    edges: list[list[float]] = []
    if numeric:
        cells = rows.select(F.posexplode(F.slice(vector_to_array("features"), 1, numeric)).alias("feature", "x"))
        names = {f"q{i:03d}": i / s.bins for i in range(1, s.bins)}
        cuts = {r["feature"]: sorted({r[q] for q in names}) for r in exact_quantiles(cells, ["feature"], "x", names).collect()}
        edges = [cuts.get(f, []) for f in range(numeric)]
    model = Boosted(classes, models, numeric, s, edges, start)
    base = _binned(rows, ["id", F.col("y").cast("int").alias("y"), F.col("_held").alias("held")], edges)
    state = _gradients(base.withColumn("scores", F.lit(start)), model)
    state = cut_lineage(state)
    if size > numeric:
        most = state.agg(*[F.max(F.get("x", F.lit(f))).alias(str(f)) for f in range(numeric, size)]).first()
        model.levels = [most[str(f)] or 0 for f in range(numeric, size)]
    # only columns too wide to broadcast a lookup for are looked through for hot codes
    hot = {f: hot_keys(state.select(F.get("x", F.lit(f)).alias("c")), "c") for f, top in enumerate(model.levels, numeric)
           if (top + 1) * (16 + 4 * model.trees * model.nodes) > SMALL_BYTES}
    wide = max([s.bins, *model.levels]) > ROWS_PER_BUCKET
    trees, nodes = model.trees, model.nodes

    for number_of_round in range(s.rounds):
        feature, cut, leaf = [-1] * (trees * nodes), [0] * (trees * nodes), [0.0] * (trees * nodes)
        sides: DataFrame | None = None
        for deep in range(s.depth + 1):
            used = sorted({f for f in feature if f >= numeric})
            placed = _with_rights(_beside(state, feature=feature, cut=cut), model, sides, used, trees * nodes, hot)
            lines = placed.select("x", F.expr(
                f"inline(filter(transform(sequence(0, {trees - 1}), t -> named_struct('t', t, 'node', {_node(model, deep, f't * {nodes}')}, "
                f"'g', g[t], 'h', h[t])), s -> s.t div {classes} <> held))"))
            sums = [F.sum("g").alias("g"), F.sum("h").alias("h")]
            if deep == s.depth:
                for r in lines.groupBy("t", "node").agg(*sums).collect():           # trees x leaves numbers
                    leaf[r["t"] * nodes + r["node"] - nodes] = -s.rate * r["g"] / (r["h"] + s.l2)
                break
            stats = lines.select("t", "node", "g", "h", F.posexplode("x").alias("feature", "bin")).groupBy("t", "node", "feature", "bin").agg(
                *sums, F.count(F.lit(1)).alias("n"))
            place = F.when(F.col("feature") < numeric, F.col("bin").cast("double")).otherwise(
                F.round(F.col("g") / (F.col("h") + s.smooth), DIGITS))
            stats = cut_lineage(stats.withColumn("place", place))
            best = _best_cuts(stats, s, wide)
            if size > numeric:
                best = cut_lineage(best)
            found = best.select("t", "node", "feature", "bin").collect()             # trees x nodes numbers
            for r in found:
                i = r["t"] * nodes + r["node"]
                feature[i], cut[i] = r["feature"], r["bin"]
            if any(r["feature"] >= numeric for r in found):
                chosen = best.where(F.col("feature") >= numeric).select(
                    "t", "node", "feature", F.struct("place", "bin").alias("_at"))
                right = stats.join(F.broadcast(chosen), ["t", "node", "feature"]).where(F.struct("place", "bin") > F.col("_at"))
                right = right.select("feature", "bin", (F.col("t") * nodes + F.col("node")).cast("int").alias("i"))
                sides = cut_lineage(right if sides is None else sides.unionByName(right))
            if not found:
                continue
        reached = f"leaf[t * {nodes} + {_node(model, s.depth, f't * {nodes}')} - {nodes}]"
        after = _with_rights(_beside(state, feature=feature, cut=cut, leaf=leaf), model, sides,
                             sorted({f for f in feature if f >= numeric}), trees * nodes, hot)
        after = after.withColumn("scores", F.expr(f"transform(scores, (s, t) -> s + {reached})")).select("id", "y", "held", "x", "scores")
        state = cut_lineage(_gradients(after, model))
        model.rounds.append((feature, cut, leaf))
        if sides is not None:
            model.sides.append(sides.withColumn("round", F.lit(number_of_round)))
    return model, state.drop("g", "h")


def probabilities(scores: str, classes: int):
    """The softmax of an array of scores."""
    return F.expr(f"transform({scores}, s -> exp(s - array_max({scores})) / aggregate({scores}, 0D, (a, v) -> a + exp(v - array_max({scores}))))")


def predict(model: Boosted, rows: DataFrame, keep: Sequence[str], which: int = 0) -> DataFrame:
    """(keep..., scores, prediction) of rows with ``features``, by model number ``which``; all rounds in one pass over the rows."""
    k, nodes, trees = model.classes, model.nodes, model.trees
    flat = [[v for r in model.rounds for v in r[j]] for j in range(3)]
    sides = None
    for part in model.sides:
        part = part.select("feature", "bin", (F.col("i") + F.col("round") * (trees * nodes)).cast("int").alias("i"))
        sides = part if sides is None else sides.unionByName(part)
    placed = _binned(rows, keep, model.edges)
    placed = _beside(placed, feature=flat[0] or [-1], cut=flat[1] or [0], leaf=flat[2] or [0.0], start=model.start)
    used = sorted({f for f in flat[0] if f >= model.numeric})
    placed = _with_rights(placed, model, sides, used, len(flat[0]), {})
    at = f"(r * {trees} + t) * {nodes}"
    step = f"leaf[{at} + {_node(model, model.settings.depth, at)} - {nodes}]"
    all_rounds = f"aggregate(sequence(0, {len(model.rounds) - 1}), start[t], (sum, r) -> sum + {step})" if model.rounds else "start[t]"
    scored = placed.withColumn("_s", F.expr(f"transform(sequence({which * k}, {which * k + k - 1}), t -> {all_rounds})"))
    return scored.select(*keep, probabilities("_s", k).alias("scores"),
                         (F.array_position("_s", F.array_max("_s")) - 1).cast("double").alias("prediction"))
