"""Node vectors learned from walks: the positive shifted PMI matrix of what is near what, factorised.

The matrix is a table of its non-zero entries. Randomised subspace iteration finds its leading part: a product with the matrix is a
join on the column and a grouped sum on the row, and only small squares (width by width) of sums reach the driver, to be inverted or
decomposed there. Nothing holds a row per node but tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import hash_text, unit_interval
from sigscreen.operators.joins import hot_keys, lookup_join
from sigscreen.runtime import cut_lineage


def cooccurrences(walks: DataFrame, window: int = 2) -> DataFrame:
    """(i, j, n): how often node j stands within ``window`` steps of node i on the walks (id, walk, path); i is not j."""
    at = walks.select("path", F.posexplode("path").alias("p", "i"))
    lo = F.greatest(F.col("p") - window, F.lit(0))
    near = F.slice("path", lo + 1, F.lit(2 * window + 1) - (window - (F.col("p") - lo)))
    return at.select(F.col("i").cast("string").alias("i"), F.explode(F.transform(near, lambda x: x.cast("string"))).alias("j")).where("i <> j").groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"))


def shifted_pmi(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """(i, j, v): ln(n N / (n_i n_j)) - ln(shift) of the counts (i, j, n), where that is above 0."""
    sums = cut_lineage(counts.groupBy("i").agg(F.sum("n").alias("s")))
    total = sums.agg(F.sum("s")).first()[0] or 0
    rows = lookup_join(counts, sums.withColumnRenamed("s", "si"), "i", "inner")
    rows = lookup_join(rows, sums.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j", "inner")
    n = F.col("n").cast("double")
    value = F.ln(n * F.lit(float(total)) / (F.col("si").cast("double") * F.col("sj"))) - F.lit(float(np.log(shift)))
    return rows.select("i", "j", value.alias("v")).where("v > 0")


def _square(rows: DataFrame, left: str, right: str, width: int) -> np.ndarray:
    """The sum over rows of the outer product of two array columns: a square in each task, added up."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().reshape(-1, width) for i in range(2))
            total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["p", "s"])

    sums = rows.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInArrow(run, "p long, s double").groupBy("p").agg(F.sum("s").alias("s"))
    out = np.zeros(width * width)
    for r in sums.collect():                                                     # width x width numbers
        out[r["p"]] = r["s"]
    return out.reshape(width, width)


def _turned(column: str, by: np.ndarray):
    """An array column times a small matrix."""
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in by.T])
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(column, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def _times(entries: DataFrame, vectors: DataFrame, width: int, hot: list) -> DataFrame:
    """(i, y): the matrix (i, j, v) times the vectors (i, q)."""
    met = lookup_join(entries, vectors.select(F.col("i").alias("j"), "q"), "j", "inner", hot)
    sums = met.groupBy("i").agg(*[F.sum(F.col("v") * F.get("q", F.lit(d))).alias(f"_{d}") for d in range(width)])
    return cut_lineage(sums.select("i", F.array(*[f"_{d}" for d in range(width)]).alias("y")))


def _upright(rows: DataFrame, width: int) -> DataFrame:
    """(i, q): the columns of (i, y) made orthonormal by the inverse root of their products; directions that have vanished become 0."""
    for _ in range(2):                  # once more takes away what rounding left
        square = _square(rows, "y", "y", width)
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
        root = (vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)) @ vectors.T
        rows = cut_lineage(rows.select("i", _turned("y", root).alias("y")))
    return rows.withColumnRenamed("y", "q")


def factorise(entries: DataFrame, dim: int = 16, extra: int = 8, rounds: int = 4, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(i, u) and the ``dim`` eigenvalues largest in size of a symmetric matrix given by its entries (i, j, v).

    u holds the node's part of each unit eigenvector, in the order of the eigenvalues; each is turned so that its sum is not negative. The
    start is drawn by hash of the node, so results repeat.
    """
    width = dim + extra
    entries = cut_lineage(entries)
    hot = hot_keys(entries, "j")
    nodes = entries.select("i").distinct()
    draw = [unit_interval(hash_text(f"{seed}.{d}", "i")) - 0.5 for d in range(width)]
    basis = _upright(cut_lineage(nodes.select("i", F.array(*draw).alias("y"))), width)
    for _ in range(rounds):
        basis = _upright(_times(entries, basis, width, hot), width)
    image = basis.join(_times(entries, basis, width, hot), "i")
    small = _square(image, "q", "y", width)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(values), kind="stable")[:dim]
    found = cut_lineage(basis.select("i", _turned("q", vectors[:, first]).alias("u")))
    sums = found.agg(*[F.sum(F.get("u", F.lit(d))).alias(str(d)) for d in range(dim)]).first()
    signs = np.diag([-1.0 if (s or 0) < 0 else 1.0 for s in sums])
    return found.select("i", _turned("u", signs).alias("u")), values[first].tolist()


def learned_embeddings(walks: DataFrame, dim: int = 16, window: int = 2, shift: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, embedding): the leading eigenvectors of the walks' shifted PMI matrix, each times the root of its eigenvalue's size."""
    found, values = factorise(shifted_pmi(cooccurrences(walks, window), shift), dim, seed=seed)
    return found.select(F.col("i").alias("id"), _turned("u", np.diag(np.sqrt(np.abs(values)))).alias("embedding"))


def rebuilt(entries: DataFrame, factors: DataFrame, values: list[float]) -> DataFrame:
    """One row about U diag(values) U' beside the matrix (i, j, v): norm and error are sums of squares of the matrix and of what is left."""
    width = len(values)
    worth = F.array(*[F.lit(float(v)) for v in values])
    cells = lookup_join(entries, factors.select("i", F.col("u").alias("a")), "i", "inner")
    cells = lookup_join(cells, factors.select(F.col("i").alias("j"), F.col("u").alias("b")), "j", "inner")
    near = F.aggregate(F.arrays_zip("a", "b", worth.alias("w")), F.lit(0.0), lambda s, x: s + x["a"] * x["b"] * x["w"])
    # what is left on the entries, and the square of the product elsewhere: all of it less that on the entries
    sums = cells.agg(F.sum(F.col("v") * F.col("v")).alias("norm"), F.sum((F.col("v") - near) ** 2).alias("on"), F.sum(near ** 2).alias("own")).first()
    square = _square(factors, "u", "u", width)
    weights = np.diag(values)
    whole = float(np.trace(square @ weights @ square @ weights))
    norm = sums["norm"] or 0.0
    error = (sums["on"] or 0.0) + whole - (sums["own"] or 0.0)
    apart = float(np.abs(square - np.eye(width)).max())
    return factors.sparkSession.createDataFrame([(norm, error, float(np.square(values).sum()), apart)], "norm double, error double, held double, apart double")
