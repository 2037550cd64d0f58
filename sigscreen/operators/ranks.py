"""Rank statistics: one-vs-rest AUC, Kruskal-Wallis, Spearman redundancy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import to_number
from sigscreen.operators.ordering import Splits, running_many, running_weights
from sigscreen.runtime import cut_lineage

MIN_AUC_VALUES = 20
SALTS = 32
CELLS = 500_000        # numbers in a block of rank vectors, about


def midranks(counts: DataFrame, value: str, groups: Sequence[str],
             splits: Splits | None = None, total: str | None = None) -> DataFrame:
    """Add ``rank`` (ties share their average) and ``ties`` to counts (groups..., value, ..., n)."""
    ranked = running_weights(counts, value, "n", groups, splits, "_before", "ties", total)
    return ranked.withColumn("rank", F.col("_before") + (F.col("ties") + 1) / 2).drop("_before")


def class_auc(cells: DataFrame, groups: Sequence[str] = ("feature",)) -> DataFrame:
    """(groups..., y, auc, n_pos, n): AUC of x for each class against the rest, missing x left out."""
    groups = list(groups)
    counts = cells.where("x is not null").groupBy(*groups, "x", "y").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = midranks(counts, "x", groups, Splits(cells, groups, "x"), "_all")
    out = ranked.groupBy(*groups, "y").agg(
        F.sum(F.col("rank") * F.col("n")).alias("s"), F.sum("n").alias("n_pos"),
        F.max("_all").alias("n"))
    # doubles: the products leave the range of a long past 3 x 10^9 rows of a class
    pos = F.col("n_pos").cast("double")
    rest = F.col("n") - F.col("n_pos")
    auc = F.when(rest > 0, (F.col("s") - pos * (pos + 1) / 2) / (pos * rest))
    return out.select(*groups, "y", auc.alias("auc"), "n_pos", "n")


def best_ovr_auc(cells: DataFrame) -> DataFrame:
    """(feature, best_auc): the best class either way round, at least 0.5; null below 20 values."""
    best = F.greatest(F.lit(0.5), F.max(F.greatest("auc", 1 - F.col("auc"))))
    return class_auc(cells).groupBy("feature").agg(
        F.when(F.max("n") >= MIN_AUC_VALUES, best).alias("best_auc"))


def kruskal_h(cells: DataFrame) -> DataFrame:
    """(feature, h): Kruskal-Wallis H with tie correction over classes of two or more values."""
    counts = cells.where("x is not null").groupBy("feature", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("feature", "y").agg(F.sum("n").alias("_ny")).where("_ny > 1")
    # One row per feature and class; Spark weighs it and picks the join.
    ranked = midranks(counts.join(large.drop("_ny"), ["feature", "y"]), "x",
                      ["feature"], Splits(cells, ["feature"], "x"))
    # Every row of a value carries its tie count t, so sum n (t^2 - 1) is sum (t^3 - t).
    by_class = ranked.groupBy("feature", "y").agg(
        F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("ny"),
        F.sum(F.col("n") * (F.col("ties").cast("double") ** 2 - 1)).alias("t"))
    sums = by_class.groupBy("feature").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("ny").cast("double").alias("N"),
        F.sum(F.col("r") ** 2 / F.col("ny")).alias("q"), F.sum("t").alias("t"))
    n = F.col("N")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    fix = 1 - F.col("t") / (n**3 - n)
    return sums.select("feature", F.when((F.col("classes") > 1) & (fix > 0), h / fix).alias("h"))


def _null_masks(df: DataFrame, id_col: str, cols: Sequence[str]) -> dict[str, int]:
    """Number of each column's set of missing rows; 0 is none missing.

    Two columns miss the same rows when the xor of the hashes of those rows agrees.
    """
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.bit_xor(F.when(to_number(c).isNull(), F.xxhash64(id_col))).alias(f"x{i}"),
        F.count(F.when(to_number(c).isNull(), F.lit(1))).alias(f"n{i}"))]).first()
    known: dict = {(None, 0): 0}
    return {c: known.setdefault((row[f"x{i}"], row[f"n{i}"]), len(known))
            for i, c in enumerate(cols)}


def spearman_pairs(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(a, b, rho) for every ordered pair of columns, each over the rows where both are present.

    Columns that miss the same rows share a mask. A value's rank among the rows that a mask leaves follows from counts by value and
    pattern of missing masks, so each cell is met once and gets its ranks under all masks as one array. Rows then become blocks of
    rank vectors, and the products of two columns are sums of outer products of such blocks: a matrix of columns by
    columns in each task, added up over the tasks. Nothing grows with the number of pairs but that matrix.
    """
    cols = list(cols)
    masks = _null_masks(df, id_col, cols)
    numbers = sorted(set(masks.values()))
    sample = [next(c for c in cols if masks[c] == m) for m in numbers]      # a column that shows whether a mask misses a row
    of = [numbers.index(masks[c]) for c in cols]
    wide = df.select(F.col(id_col).alias("id"), *[to_number(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    there = F.array(*[F.col(f"_x{cols.index(c)}").isNotNull() for c in sample])
    cells = wide.select("id", there.alias("there"), F.posexplode(F.array(*[f"_x{i}" for i in range(len(cols))])).alias("f", "x")).where(
        "x is not null")

    counted = [f"n{m}" for m in range(len(numbers))]
    counts = cells.groupBy("f", "x").agg(*[F.sum(F.get("there", F.lit(m)).cast("bigint")).alias(c) for m, c in enumerate(counted)])
    splits = Splits(cells, ["f"], "x")
    ranked = running_many(counts, "x", counted, ["f"], splits)
    # the mean rank is taken off at once, so that products are covariances
    ranks = [F.col(f"before_{c}") + (F.col(c) + 1) / 2 - (F.col(f"total_{c}") + 1) / 2 for c in counted]
    ranked = cut_lineage(ranked.select("f", "x", F.array(*[r.cast("double") for r in ranks]).alias("r"), F.array(*counted).alias("n")))
    own = ranked.select("f", F.posexplode(F.arrays_zip("r", "n")).alias("m", "_v")).groupBy("f", "m").agg(
        F.sum(F.col("_v.n") * F.col("_v.r") * F.col("_v.r")).alias("squares"))                # a row per column and mask

    # A value with a large share of the rows is a hot join key. It is a split point, so
    # both sides know it without counting, and its rows are spread by a salt.
    hot = F.col("_heavy")
    left = splits.bucketed(cells, "x").select("id", "there", "f", "x", F.when(
        hot, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt"))
    right = splits.bucketed(ranked, "x").select("f", "x", "r", F.explode(F.when(
        hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    met = left.join(right, ["f", "x", "_salt"]).select(
        F.xxhash64("id").alias("row"), F.hash("id").alias("other"), "f", F.transform("r", lambda v, m: F.when(F.get("there", m), v).otherwise(0.0)).alias("r"))

    by_mask = [(m, np.flatnonzero(np.array(of) == m)) for m in range(len(numbers))]
    size = max(1, CELLS // (len(cols) * len(numbers)))       # rows in a block

    def outer(batches):
        total, held, rows = np.zeros((len(cols), len(cols))), [], 0

        def add():
            row, other, f, r = (np.concatenate([h[i] for h in held]) for i in range(4))
            new = np.append(True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]))
            at = np.cumsum(new) - 1
            for lo in range(0, at[-1] + 1, size):
                cut = slice(*np.searchsorted(at, (lo, lo + size)))
                block = np.zeros((size, len(cols), len(numbers)))
                block[at[cut] - lo, f[cut]] = r[cut]
                for m, of_m in by_mask:
                    for k, of_k in by_mask:
                        total[np.ix_(of_m, of_k)] += block[:, of_m, k].T @ block[:, of_k, m]

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = [batch.column(i).to_numpy() for i in range(3)]
            cut.append(batch.column(3).flatten().to_numpy().reshape(-1, len(numbers)))
            if rows >= CELLS:                 # all cells of a row go into one block, so wait for the end of the last row
                same = (cut[0] == last[0]) & (cut[1] == last[1])
                end = len(same) if same.all() else int(same.argmin())
                held.append([c[:end] for c in cut])
                rows += end
                if end < len(same):
                    add()
                    held, rows = [], 0
                cut = [c[end:] for c in cut]
            if len(cut[0]):
                held.append(cut)
                rows += len(cut[0])
                last = cut[0][-1], cut[1][-1]
        if held:
            add()
        a, b = np.triu_indices(len(cols), 1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["i", "j", "s"])

    sums = met.repartition("row").sortWithinPartitions("row", "other").mapInArrow(outer, "i long, j long, s double")
    sums = sums.groupBy("i", "j").agg(F.sum("s").alias("s"))
    names = df.sparkSession.createDataFrame([(i, c, m) for i, (c, m) in enumerate(zip(cols, of))], "i long, name string, mask int")
    first = sums.join(F.broadcast(names.withColumnsRenamed({"name": "a", "mask": "mi"})), "i").join(
        F.broadcast(names.withColumnsRenamed({"i": "j", "name": "b", "mask": "mj"})), "j")
    own = F.broadcast(own)
    both = first.join(own.select(F.col("f").alias("i"), F.col("m").alias("mj"), F.col("squares").alias("va")), ["i", "mj"]).join(
        own.select(F.col("f").alias("j"), F.col("m").alias("mi"), F.col("squares").alias("vb")), ["j", "mi"])
    rho = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("s") / F.sqrt(F.col("va")) / F.sqrt(F.col("vb")))
    return both.select(F.explode(F.array(F.struct("a", "b", rho.alias("rho")), F.struct(
        F.col("b").alias("a"), F.col("a").alias("b"), rho.alias("rho")))).alias("_p")).select("_p.*")


def spearman_redundancy(pairs: DataFrame, above: float = 0.9) -> DataFrame:
    """(feature, redundant_with, rho): strongest partner of each column, where above the limit."""
    size = F.round(F.abs("rho"), 12)    # equal up to rounding is a tie: the first name wins
    best = pairs.where("rho is not null").groupBy(F.col("a").alias("feature")).agg(
        F.min_by("b", F.struct(-size, F.col("b"))).alias("redundant_with"),
        F.max(size).alias("rho"))
    return best.where(F.col("rho") > above)
