"""Fold assignment. Everything that reads a label takes folds from here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.operators.ordering import hash_positions
from sigscreen.runtime import cut_lineage

UNLABELED = -1


def stratified_folds(entities: DataFrame, id_col: str, label: str, k: int = 5,
                     seed: int = 0) -> DataFrame:
    """(id, label, fold): each class is dealt round robin in hash order; unlabeled ids get -1.

    ``entities`` has one row per id.
    """
    rows = entities.select(id_col, label)
    labeled = hash_positions(rows.where(F.col(label).isNotNull()), [id_col], [label], seed, "_pos")
    labeled = labeled.select(id_col, label, ((F.col("_pos") - 1) % k).cast("int").alias("fold"))
    rest = rows.where(F.col(label).isNull()).withColumn("fold", F.lit(UNLABELED))
    return labeled.unionByName(rest)


def lightest_runs(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, last, folds): where the groups first..last of a size go, one after the other, each to the fold with the fewest rows.

    ``sizes`` lists (size, number of groups). Groups go by size, the largest first; ties go to the lowest fold. A fold that lies far behind takes
    many groups at once, and level folds take turns, so the work is a few steps per size, however many groups there are.
    """
    loads = [0] * k
    runs = []
    for size, groups in sorted(sizes, reverse=True):
        at = 1
        while at <= groups:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            # folds that are level take turns, and stand as before after each, until the last of them has passed the next fold
            turn = [f for f in order if (loads[f], f) < (loads[order[0]] + size, order[0])]
            n = groups - at + 1
            if len(turn) < k:
                last, ahead = turn[-1], order[len(turn)]
                gap = loads[ahead] - loads[last]
                n = min(n, len(turn) * (gap // size + 1 if last < ahead else -(-gap // size)))
            for i, f in enumerate(turn):
                loads[f] += size * (n // len(turn) + (i < n % len(turn)))
            runs.append((size, at, at + n - 1, turn))
            at += n
    return runs


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): groups are dealt to at most ``k`` folds, the largest first, each to the fold with the fewest rows so far.

    Which fold takes the how-manieth group of a size follows from the sizes and how many groups have each: at most the root of
    twice the number of rows. Groups of one size are taken in hash order, by their position in it.
    """
    sizes = cut_lineage(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    seen = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()
    runs = lightest_runs([(r["n"], r["groups"]) for r in seen], min(k, sum(r["groups"] for r in seen)) or 1)
    dealt = df.sparkSession.createDataFrame(runs, "n long, _first long, _last long, _folds array<int>")
    ranked = hash_positions(sizes, [group], ["n"], 0, "_pos")
    # a few rows per size: never more than some times the root of the table's rows
    out = ranked.join(F.broadcast(dealt), "n").where(F.col("_pos").between(F.col("_first"), F.col("_last")))
    turn = ((F.col("_pos") - F.col("_first")) % F.size("_folds")).cast("int")
    return out.select(group, F.col("n").cast("bigint"), F.get("_folds", turn).alias("fold"))


def holdout(df: DataFrame, id_col: str, label: str, share: float = 0.3,
            seed: int = 0) -> DataFrame:
    """Add ``is_test``: the first ``share`` of each class in hash order."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_positions(df, [id_col], [label], seed, "_pos")
    ranked = ranked.join(F.broadcast(sizes), label)  # one row per class
    return ranked.withColumn("is_test", F.col("_pos") <= F.floor(F.col("_n") * share)).select(
        *df.columns, "is_test")


def group_leakage(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups whose rows lie in more than one fold, as (group, folds)."""
    seen = df.where(F.col(group).isNotNull() & (F.col(fold) != UNLABELED))
    return seen.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")
