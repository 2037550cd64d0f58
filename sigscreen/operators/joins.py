"""Joins of large tables to tables with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1 / 200    # a key with more rows than this share is hot: at most 200 keys
SALTS = 32
SMALL_ROWS = 100_000   # a lookup within both bounds is broadcast
SMALL_BYTES = 16_000_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows, found in one pass with a small sketch.

    The sketch tracks 50 times as many items as there can be hot keys, so none is
    missed. The answer only steers salting: it never changes a result.
    """
    most = int(1 / share)
    row = df.agg(
        F.count(key).alias("n"),
        F.expr(f"approx_top_k(`{key}`, {most}, {most * 50})").alias("top"),
    ).first()
    floor = max(row["n"] * share, 1000)
    return [t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] > floor]


def is_small(df: DataFrame) -> bool:
    """Whether the rows, counted and weighed, are few enough to send to every executor."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
           for f in df.schema.fields):
        return False
    width = F.lit(8 * len(df.columns))
    for c in texts:
        width = width + F.coalesce(F.octet_length(c), F.lit(0))
    row = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return row["n"] <= SMALL_ROWS and (row["b"] or 0) <= SMALL_BYTES


def lookup_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "left",
                hot: list | None = None) -> DataFrame:
    """Join ``big`` to ``lookup`` (unique on ``key``).

    A lookup whose size is checked to be small is broadcast. Otherwise the rows of hot
    keys are spread by a salt; only those keys are repeated on the lookup side, which
    adds at most 200 x ``SALTS`` rows. Pass ``hot`` when the hot keys are known already.
    """
    if hot is None:
        if is_small(lookup):
            return big.join(F.broadcast(lookup), key, how)
        hot = hot_keys(big, key)
    if not hot:
        return big.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")
    big = big.withColumn("_salt", F.when(is_hot, spread).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lookup = lookup.withColumn("_salt", F.explode(copies))
    return big.join(lookup, [key, "_salt"], how).drop("_salt")
