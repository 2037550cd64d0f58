"""Global order without a global sort: row numbers, running sums, exact quantiles.

A window over a whole feature or class would put all of its rows in one task.
Here every group is first cut into buckets that respect the order, each bucket is
sorted on its own, and the sizes of the earlier buckets are added as offsets.

* Order by hash: the leading hex digits of an md5 are even buckets by themselves.
* Order by value: split points come from one ``percentile_approx`` pass over a
  share of the rows. A value that would fill a bucket is a split point; it gets a
  bucket of its own, which is cut further by the tie-breaking hash. So one value
  may hold any share of the rows. The points only balance the work: whatever they
  are, the numbers that come out are the same.

Split points (at most ``MAX_SPLITS`` numbers for a group above a bucket's size, none for
others) are written once, so that all branches of a plan use the same buckets. The driver
learns only how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigscreen.functions.columns import hash_text
from sigscreen.operators.joins import SALTS, SMALL_BYTES
from sigscreen.runtime import cut_lineage

HASH_DIGITS = 3        # 4,096 buckets for an order by hash
TIE_DIGITS = 2         # 256 buckets inside one heavy value
MAX_SPLITS = 1023      # split points per group for an order by value
ROWS_PER_BUCKET = 100_000
SKETCH_SHARE = 1 / 32  # rows that the split points are estimated from; results do not depend on it


def _offsets(rows: DataFrame, groups: Sequence[str], bucket: Sequence[str], weight: Column,
             name: str, total: str | None = None) -> DataFrame:
    """Sum of ``weight`` over all earlier buckets of the group (and over all), one row per bucket."""
    sizes = rows.groupBy(*groups, *bucket).agg(F.sum(weight).alias("_size"))
    # Bounded windows: one row per bucket, never one per input row.
    group = W.partitionBy(*groups).orderBy(*bucket)
    earlier = group.rowsBetween(W.unboundedPreceding, -1)
    out = [F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias(name)]
    if total:
        whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        out.append(F.sum("_size").over(whole).alias(total))
    return sizes.select(*groups, *bucket, *out)


def running_totals(df: DataFrame, by: Sequence[str], order: str, weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` up to and with each row, in the order of a column of any type, within ``by``.

    ``order`` is unique within ``by``. Rows are dealt by ranges of the order; a range is summed on its own, and the sums of the earlier
    ranges, a few numbers per range, are added. The dealt rows are written, so that all that follows sees the same ranges.
    """
    by = list(by)
    dealt = cut_lineage(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    local = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return dealt.join(sums, [*by, "_range"]).withColumn(name, F.col("_earlier") + F.sum(weight).over(local)).select(*df.columns, name)


def hash_positions(df: DataFrame, ids: Sequence[str], groups: Sequence[str] = (),
                   seed: str | int = 0, name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in the md5 order of its ids, within ``groups``."""
    groups = list(groups) or ["_all"]
    rows = df if groups != ["_all"] else df.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_h", hash_text(seed, *ids)).withColumn(
        "_b", F.substring("_h", 1, HASH_DIGITS))
    offsets = _offsets(rows, groups, ["_b"], F.lit(1), "_before")
    local = W.partitionBy(*groups, "_b").orderBy("_h", *ids)
    out = rows.join(offsets, [*groups, "_b"]).withColumn(
        name, (F.col("_before") + F.row_number().over(local)).cast("bigint"))
    return out.select(*df.columns, name)


class Splits:
    """Split points per group, and the bucket expression that they define.

    Best built on the rows themselves, before any shuffle: the sketch is filled on the
    map side. Rows count, not distinct values, so no bucket holds more than its share of
    rows, and a table of value counts has fewer still.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], value: str, parts: int = 1):
        """``parts``: into how many equal groups the windows will cut each group of ``by``."""
        self.by = list(by)
        probs = ", ".join(f"{i / (MAX_SPLITS + 1)}D" for i in range(1, MAX_SPLITS + 1))
        seen = df.select(*self.by, F.col(value).cast("double").alias("_v")).where("_v is not null")
        if SKETCH_SHARE < 1:
            seen = seen.sample(SKETCH_SHARE, 0)
        found = seen.groupBy(*self.by).agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"percentile_approx(_v, array({probs}), 5000)").alias("points"))
        want = F.least(F.lit(MAX_SPLITS), F.floor(F.col("n") / F.lit(SKETCH_SHARE * ROWS_PER_BUCKET * parts)))
        step = F.lit(MAX_SPLITS + 1.0) / (F.col("want") + 1)
        picked = F.transform(F.sequence(F.lit(1), F.col("want")), lambda i: F.element_at(
            "points", F.floor(i * step).cast("int")))
        # only groups above a bucket's size have points; they stay in a table, which every branch reads
        found = cut_lineage(found.withColumn("want", want.cast("int")).where("want > 0").select(
            *self.by, F.array_sort(F.array_distinct(picked)).alias("_points")))
        row = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_points")).alias("most")).first()
        self.table = None
        if row["n"]:
            # All lists are padded to one length, 2^n - 1, for a search of n steps.
            self.steps = row["most"].bit_length()
            size = 2**self.steps - 1
            self.small = row["n"] * size * 8 <= SMALL_BYTES
            self.table = found.withColumn("_points", F.concat("_points", F.array_repeat(
                F.lit(float("inf")), F.lit(size) - F.size("_points"))))

    def bucketed(self, df: DataFrame, value: str, tie: Sequence[str] = ()) -> DataFrame:
        """Add ``_b`` (ordered bucket), ``_heavy`` (the bucket is one value) and ``_sub``."""
        if self.table is None:
            return df.withColumns({"_b": F.lit(0), "_heavy": F.lit(False), "_sub": F.lit("")})
        v = F.col(value).cast("double")
        if self.small:
            out = df.join(F.broadcast(self.table), self.by, "left")
        else:                   # every listed group is large, so the rows of each are spread
            salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
            copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
            out = df.withColumn("_salt", salt).join(
                self.table.select("*", copies), [*self.by, "_salt"], "left").drop("_salt")
        out = out.withColumn("_at", F.lit(0))
        for step in reversed(range(self.steps)):
            # Number of split points below the value, one binary digit at a time.
            far = F.get("_points", F.col("_at") + (2**step - 1)) < v
            out = out.withColumn("_at", F.col("_at") + F.when(far, 2**step).otherwise(0))
        on_point = F.coalesce(F.get("_points", F.col("_at")) == v, F.lit(False))
        out = out.withColumn("_heavy", on_point).withColumn(
            "_b", F.col("_at") * 2 + F.col("_heavy").cast("int"))
        sub = F.lit("")
        if tie:
            sub = F.when(F.col("_heavy"), F.substring(hash_text(0, *tie), 1, TIE_DIGITS)
                         ).otherwise("")
        return out.withColumn("_sub", sub).drop("_points", "_at")


def value_positions(df: DataFrame, value: str, ids: Sequence[str], groups: Sequence[str] = (),
                    splits: Splits | None = None, name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row by (value, md5 of ids, ids) within ``groups``.

    ``splits`` may be built on a coarser grouping than ``groups``.
    """
    groups = list(groups)
    rows = df
    if not groups:
        groups, rows = ["_all"], df.withColumn("_all", F.lit(0))
    if splits is None:
        splits = Splits(rows, groups, value)
    rows = splits.bucketed(rows, value, ids)
    offsets = _offsets(rows, groups, ["_b", "_sub"], F.lit(1), "_before")
    local = W.partitionBy(*groups, "_b", "_sub").orderBy(value, hash_text(0, *ids), *ids)
    out = rows.join(offsets, [*groups, "_b", "_sub"]).withColumn(
        name, (F.col("_before") + F.row_number().over(local)).cast("bigint"))
    return out.select(*df.columns, name)


def running_weights(counts: DataFrame, value: str, weight: str, groups: Sequence[str],
                    splits: Splits | None = None, before: str = "before",
                    tied: str | None = None, total: str | None = None,
                    then: Sequence[str] = ()) -> DataFrame:
    """Add ``before``: the weight of all rows with a smaller value in the group.

    Rows are pre-counted, so that a hot value is only a few rows. With ``tied``, several
    rows may share a value and the weight of all of them is added too; otherwise rows
    of one value (and ``then``, which orders such rows) must be one row, or weigh nothing.
    ``total`` adds the weight of the whole group.
    """
    groups = list(groups)
    if splits is None:
        splits = Splits(counts, groups, value)
    rows = splits.bucketed(counts, value)
    offsets = _offsets(rows, groups, ["_b"], F.col(weight), "_earlier", total)
    # Both frames use one sort.
    order = W.partitionBy(*groups, "_b").orderBy(value, *then)
    out = rows.join(offsets, [*groups, "_b"])
    if tied:
        same = order.rangeBetween(W.currentRow, W.currentRow)
        out = out.select("*", F.sum(weight).over(order).alias("_upto"),
                         F.sum(weight).over(same).alias(tied))
        smaller = F.col("_upto") - F.col(tied)
    else:
        upto = F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        out = out.select("*", upto.alias("_upto"))
        smaller = F.col("_upto") - F.col(weight)
    out = out.withColumn(before, F.col("_earlier") + smaller)
    return out.select(*counts.columns, before, *[c for c in (tied, total) if c])


def running_many(counts: DataFrame, value: str, weights: Sequence[str], groups: Sequence[str], splits: Splits) -> DataFrame:
    """Add ``before_w`` and ``total_w`` for each weight column w: as ``running_weights``, with one sort for all of them.

    A value is one row of its group.
    """
    groups = list(groups)
    rows = splits.bucketed(counts, value)
    sizes = rows.groupBy(*groups, "_b").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    group = W.partitionBy(*groups).orderBy("_b")
    earlier, whole = group.rowsBetween(W.unboundedPreceding, -1), group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sizes = sizes.select(*groups, "_b", *[F.coalesce(F.sum(f"_s_{w}").over(earlier), F.lit(0)).alias(f"_e_{w}") for w in weights],
                         *[F.sum(f"_s_{w}").over(whole).alias(f"total_{w}") for w in weights])
    local = W.partitionBy(*groups, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(sizes, [*groups, "_b"]).select(
        *counts.columns, *[(F.col(f"_e_{w}") + F.coalesce(F.sum(w).over(local), F.lit(0))).alias(f"before_{w}") for w in weights],
        *[f"total_{w}" for w in weights])
    return out


def value_counts(df: DataFrame, groups: Sequence[str], value: str, name: str = "n") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias(name))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Works from value counts, so no group's values are gathered in one task.
    """
    groups = list(groups)
    counts = value_counts(df, groups, value)
    ranked = running_weights(counts, value, "n", groups, Splits(df, groups, value),
                             total="_total")
    picks = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
    found = ranked.groupBy(*groups).agg(*picks)
    return found.select(*groups, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
        for n in probs
    ])
