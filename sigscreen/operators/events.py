"""Features from fact tables: places, shares, activity hours, tenure, amounts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import days_between, norm_category, xlogx
from sigscreen.operators.counts import category_counts, summarise_counts
from sigscreen.operators.joins import hot_keys, is_small, lookup_join


def fact_dim_join(fact: DataFrame, dim: DataFrame, key: str, cols: Sequence[str],
                  how: str = "inner", hot: list | None = None) -> DataFrame:
    """Fact rows with columns of a dimension that is unique on ``key``.

    A small dimension is broadcast by Spark's own size check; for a larger one the
    rows of hot keys are salted.
    """
    return lookup_join(fact, dim.select(key, *cols), key, how, hot)


def modal_place(fact: DataFrame, dim: DataFrame, entity: str, key: str, place: str,
                top: str, frac: str | None = None, entropy: str | None = None,
                hot: list | None = None) -> DataFrame:
    """Most frequent place of each entity, its share and entropy."""
    placed = _visited(fact, dim.select(key, place), entity, key, hot)
    counts = placed.where(F.col(place).isNotNull()).groupBy(entity, place).agg(
        F.sum("n").alias("n"))
    return summarise_counts(counts, entity, place, top, frac, entropy)


def _visited(fact: DataFrame, dim: DataFrame, entity: str, key: str, hot: list | None = None) -> DataFrame:
    """(key, entity, n) of the visits with the columns of a dimension that is unique on ``key``.

    A small dimension is sent to the visits as they are; otherwise they are counted by (entity, key) first, so the join sees each pair
    once. Hot keys come from the visits as they are: counting them would cost all that the join needs, and counts only shrink a key.
    """
    if hot is None:
        if is_small(dim):
            known = fact.where(F.col(key).isNotNull()).select(key, entity, F.lit(1).cast("bigint").alias("n"))
            return known.join(F.broadcast(dim), key)
        hot = hot_keys(fact, key)
    return lookup_join(category_counts(fact, entity, key), dim, key, "inner", hot)


def modal_merchant(fact: DataFrame, dim: DataFrame, entity: str, key: str, place: str,
                   pattern: str, prefix: str = "city_", width: int = 2,
                   top: str = "merch_modal_city", frac: str = "merch_top_frac",
                   hot: list | None = None) -> DataFrame:
    """``modal_place`` over normalised names; unmatched names are dropped."""
    clean = dim.select(key, norm_category(place, pattern, prefix, width).alias("_place"))
    return modal_place(fact, clean, entity, key, "_place", top, frac, hot=hot)


def merchant_blocks(fact: DataFrame, dim: DataFrame, entity: str, key: str, place: str, flag: str, pattern: str, prefix: str = "city_",
                    width: int = 2, hot: list | None = None) -> list[DataFrame]:
    """``modal_merchant`` and the share of visits whose merchant has the flag, from one count of visits, one join and one row per place."""
    clean = dim.select(key, norm_category(place, pattern, prefix, width).alias("_place"), F.col(flag).alias("_flag"))
    n = F.col("n")
    placed = _visited(fact, clean, entity, key, hot).groupBy(entity, "_place").agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("_flag"), n)).alias("_yes"), F.sum(F.when(F.col("_flag").isNotNull(), n)).alias("_known"))
    # Visits without a place still count for the flag.
    named = F.when(F.col("_place").isNotNull(), n)
    return [placed.groupBy(entity).agg(
        F.min_by("_place", F.when(named.isNotNull(), F.struct(-n, F.col("_place")))).alias("merch_modal_city"),
        F.try_divide(F.max(named), F.sum(named)).alias("merch_top_frac"),
        F.try_divide(F.coalesce(F.sum("_yes"), F.lit(0)), F.sum("_known")).alias("merch_online_frac"))]


def bool_share(df: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """Share of true among the non-null flags."""
    return df.groupBy(key).agg(F.avg(F.col(flag).cast("double")).alias(name))


def hour_stats(df: DataFrame, key: str, ts: str, mean: str = "act_hour_mean",
               std: str = "act_hour_std", count: str = "app_event_count") -> DataFrame:
    """Mean and sample deviation of the hour of day, and the number of events."""
    h = F.hour(ts).cast("double")
    return df.groupBy(key).agg(
        F.avg(h).alias(mean), F.stddev_samp(h).alias(std), F.count(F.lit(1)).alias(count))


def hour_circular(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Mean hour on the clock face (23 and 1 average to 0), and how concentrated the hours are."""
    angle = F.hour(ts) * F.lit(2.0) * F.pi() / 24.0
    sums = df.groupBy(key).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"))
    hour = F.pmod(F.atan2("_s", "_c") * 24.0 / (F.lit(2.0) * F.pi()) + 24.0, F.lit(24.0))
    length = F.sqrt(F.col("_s") ** 2 + F.col("_c") ** 2)
    # Opposite hours cancel out: without a direction there is no mean hour.
    return sums.select(key, F.when(length > 1e-9, hour).alias("hour_circ_mean"),
                       length.alias("hour_concentration"))


def tenure(df: DataFrame, key: str, start: str, ref: datetime | str,
           name: str = "tenure_days") -> DataFrame:
    """Whole 24-hour days from the start to the reference time."""
    return df.select(key, days_between(F.lit(ref).cast("timestamp"), F.col(start)).alias(name))


def amount_shape(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Mean, coefficient of variation, skewness, and entropy of the amounts' shares of the total."""
    x = F.col(amount)
    total = F.sum(F.when(x > 0, x))
    # Amounts of zero or less take no share.
    entropy = F.greatest(F.lit(0.0), F.ln(total) - F.sum(F.when(x > 0, xlogx(x))) / total)
    return df.groupBy(key).agg(
        F.avg(x).alias("amount_mean"),
        F.try_divide(F.stddev_samp(x), F.avg(x)).alias("amount_cv"),
        F.skewness(x).alias("amount_skew"),
        entropy.alias("amount_entropy"))
