"""Row cleaning, presence flags, edge orientation and stratified sampling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import as_col
from sigscreen.operators.ordering import hash_positions


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must break all ties that matter.

    An aggregate rather than a window, so that a hot key is reduced before the shuffle.
    """
    keys = list(keys)
    # Nulls last, as in an ascending order with missing values at the end.
    rank = F.struct(*[e for i, c in enumerate(order) for e in (
        as_col(c).isNull().alias(f"null{i}"), as_col(c).alias(f"key{i}"))])
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row"))
    return picked.select("_row.*")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def presence_flag(spine: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Add 1 where ``other`` has a row for the key, else 0."""
    present = other.select(key).distinct().withColumn("_present", F.lit(1))
    return spine.join(present, key, "left").withColumn(
        name, F.coalesce(F.col("_present"), F.lit(0)).cast("int")).drop("_present")


def time_fence(df: DataFrame, ts: str, cutoff: datetime | str) -> DataFrame:
    """Rows strictly before the cutoff; apply it before any aggregate."""
    return df.where(F.col(ts) < F.lit(cutoff).cast(df.schema[ts].dataType))


def symmetric_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Both directions of every edge as (a, b), with multiplicity kept."""
    # One scan: each row is turned into its two directions in place.
    both = F.explode(F.array(
        F.struct(F.col(src).alias("a"), F.col(dst).alias("b")),
        F.struct(F.col(dst).alias("a"), F.col(src).alias("b"))))
    return edges.select(both.alias("_e")).select("_e.a", "_e.b")


def stratified_sample(df: DataFrame, id_col: str, label: str, rows: int,
                      seed: int = 0) -> DataFrame:
    """At most ``rows // classes`` rows of each class, the first by hash; rare classes stay whole."""
    classes = max(1, df.select(label).where(F.col(label).isNotNull()).distinct().count())
    per = max(1, rows // classes)
    kept = hash_positions(df, [id_col], [label], seed, "_pos")
    return kept.where(F.col("_pos") <= per).drop("_pos")
