"""Aggregates by key. Each starts from counts, so a hot key is reduced before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import as_col, xlogx
from sigscreen.operators.joins import lookup_join
from sigscreen.operators.ordering import hash_positions, value_positions
from sigscreen.runtime import cut_lineage


def category_counts(df: DataFrame, key: str, cat: str, weight: str | None = None) -> DataFrame:
    """(key, category, n) of the non-null categories."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(cat).isNotNull()).groupBy(key, cat).agg(n.alias("n"))


def entropy_of(n: str | Column) -> Column:
    """Entropy in nats of a group's counts: ln S - (sum of n ln n) / S."""
    total = F.sum(n)
    return F.greatest(F.lit(0.0), F.ln(total) - F.sum(xlogx(n)) / total)


def top_category(cat: str, n: str) -> Column:
    """Most frequent category; the smallest one on a tie."""
    return F.min_by(F.col(cat), F.struct(-F.col(n), F.col(cat)))


def summarise_counts(counts: DataFrame, key: str, cat: str, top: str, frac: str | None = None,
                     entropy: str | None = None, total: str | None = None) -> DataFrame:
    """One row per key from (key, category, n)."""
    out = [top_category(cat, "n").alias(top)]
    if frac:
        out.append((F.max("n") / F.sum("n")).alias(frac))
    if entropy:
        out.append(entropy_of("n").alias(entropy))
    if total:
        out.append(F.sum("n").cast("bigint").alias(total))
    return counts.groupBy(key).agg(*out)


def modal_category(df: DataFrame, key: str, cat: str, prefix: str,
                   weight: str | None = None) -> DataFrame:
    """Most frequent category of each key, its share and the entropy of the distribution."""
    return summarise_counts(category_counts(df, key, cat, weight), key, cat,
                            prefix, f"{prefix}_frac", f"{prefix}_entropy")


def entropy_by_key(df: DataFrame, key: str, cat: str, name: str = "entropy") -> DataFrame:
    return category_counts(df, key, cat).groupBy(key).agg(entropy_of("n").alias(name))


def mode_by_key(df: DataFrame, key: str, cat: str, name: str) -> DataFrame:
    """Most frequent non-null value, the smallest on a tie."""
    return category_counts(df, key, cat).groupBy(key).agg(top_category(cat, "n").alias(name))


def degree_distinct(df: DataFrame, key: str, other: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(other).alias(name))


def share_of_group(df: DataFrame, key: str, cat: str) -> DataFrame:
    """(key, category, n, share). The totals are joined back, since a key may have many categories."""
    counts = category_counts(df, key, cat)
    totals = counts.groupBy(key).agg(F.sum("n").alias("_total"))
    return lookup_join(counts, totals, key, "inner").withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def concat_text(df: DataFrame, key: str, text: str, order: str, ids: Sequence[str],
                rows_per_part: int = 10_000) -> DataFrame:
    """Texts of each key joined by spaces in order, as (key, part, text).

    Parts in order make up the whole text. A part holds ``rows_per_part`` texts, so
    that one key with very many texts is not gathered in a single task.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, text, order, *[
        c for c in ids if c not in (key, order)])
    rows = value_positions(rows, order, ids, [key], name="_pos")
    part = F.floor((F.col("_pos") - 1) / rows_per_part).cast("bigint")
    gathered = rows.groupBy(key, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col(text).alias("_t")))).alias("_rows"))
    joined = F.concat_ws(" ", F.transform("_rows", lambda r: r["_t"]))
    return gathered.select(key, "part", joined.alias("text"))


def marker_counts(df: DataFrame, key: str, text: str, pattern: str, name: str = "marker",
                  prefix: str = "") -> DataFrame:
    """(key, marker, n): every match of the pattern's one group, over whole texts."""
    found = df.where(F.col(text).rlike(pattern)).select(key, F.explode(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("_m"))
    return found.groupBy(key, F.concat(F.lit(prefix), F.col("_m")).alias(name)).agg(
        F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null share of each column as (feature, coverage), from one pass."""
    # An empty table has no share; avg gives null there.
    one = df.agg(*[F.avg(as_col(c).isNotNull().cast("double")).alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "coverage")


def label_entropy(df: DataFrame, label: str) -> DataFrame:
    """One row: class count, row count and label entropy in nats, at least 1e-9."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"),
        F.greatest(entropy_of("n"), F.lit(1e-9)).alias("entropy"))


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n) for every pair of classes, zeros included.

    The classes are numbered, and each meets the numbers of all, so no task holds the list of them.
    """
    counts = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.select(F.explode(F.array(label, predicted)).alias("c")).where("c is not null").distinct()
    classes = cut_lineage(hash_positions(seen, ["c"], name="_i"))
    upto = F.lit(classes.count()).cast("bigint")
    grid = classes.select(F.col("c").alias(label), F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(upto, F.lit(1)))).alias("_i")).join(
        classes.select(F.col("c").alias(predicted), "_i"), "_i").drop("_i")
    return grid.join(counts, [label, predicted], "left").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), tie).limit(k)


__all__ = [
    "category_counts", "concat_text", "confusion_matrix", "coverage", "degree_distinct",
    "entropy_by_key", "entropy_of", "label_entropy", "marker_counts",
    "modal_category", "mode_by_key", "share_of_group", "summarise_counts", "top_category", "top_k",
]
