"""Nearest rows of the same class along one number, for many labelings of the same rows at once.

A labeling changes classes, never numbers, so the numbers are put in order once: a bucket of consecutive values becomes one row of
packed arrays, its numbers and its class codes by labeling. Neighbors beyond a bucket come from the first and last rows of each
class in the other buckets, a few numbers per bucket, labeling and class. A distance that reaches out of its bucket is
counted in the bucket where it ends.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscreen.operators.ordering import Splits
from sigscreen.runtime import cut_lineage

# the functions below travel with the tasks, so workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, n of them, one run after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values, pa.float64()))


def _pack(keys: Sequence[str], labelings: int, k: int):
    """A bucket's rows become a row of arrays, and rows with the outer numbers of each labeling and class."""
    def pack(t: pa.Table) -> pa.Table:
        x, u = t["x"].to_numpy(), t["u"].to_numpy()
        order = np.argsort(x, kind="stable")
        x, u = x[order], u[order]
        ys = t["ys"].combine_chunks().flatten().to_numpy().reshape(-1, labelings)
        kind = next(d for d in (np.int8, np.int16, np.int32) if ys.max() <= np.iinfo(d).max)
        ys = np.ascontiguousarray(ys.astype(kind)[order].T)
        parts = [[], [], [], [], []]
        for j, codes in enumerate(ys):
            by = np.argsort(codes, kind="stable")
            own, at = codes[by], x[by]
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            n = np.diff(np.append(start, len(own)))
            known = own[start] >= 0
            start, n = start[known], n[known]
            few = np.minimum(n, k)
            for part, v in zip(parts, (np.full(len(n), j + 1), own[start], n, at[_runs(start, few)], at[_runs(start + n - few, few)])):
                part.append(v)
        j, c, n, first, last = (np.concatenate(p) for p in parts)
        few = np.minimum(n, k)
        rows = len(n)

        def ahead(values: pa.Array) -> pa.Array:      # the row of arrays comes first
            return pa.concat_arrays([pa.nulls(1, values.type), values])

        def alone(values: np.ndarray) -> pa.Array:
            return pa.array([values.tobytes(), *[None] * rows], pa.binary())

        fixed = [pa.array([t[c][0].as_py()] * (rows + 1), t.schema.field(c).type) for c in (*keys, "_b")]
        return pa.Table.from_arrays(
            [*fixed, ahead(pa.array(j, pa.int32())), ahead(pa.array(c, pa.int32())), ahead(pa.array(n, pa.int64())),
             ahead(_lists(first, few)), ahead(_lists(last, few)), alone(x), alone(ys), alone(u if u.any() else u[:0])],
            names=[*keys, "_b", "_k", "c", "n", "f", "l", "x", "y", "u"])
    return pack


def _unpacked(t: pa.Table, labelings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(t["x"][0].as_py())
    y = t["y"][0].as_py()
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(y) // (len(x) * labelings)]
    return x, np.frombuffer(y, kind).reshape(labelings, -1), np.frombuffer(t["u"][0].as_py(), np.int64)


def _kth(x: np.ndarray, same: np.ndarray, k: int) -> list[np.ndarray]:
    """The 1st to k-th least distance to a row of the same class; rows are in order of (class, number)."""
    left, right = [], []
    for i in range(1, k + 1):
        gap = np.full(max(len(x) - i, 0), np.inf)
        np.subtract(x[i:], x[:-i], out=gap, where=same[i:] == same[:-i])
        ends = np.full(min(i, len(x)), np.inf)
        left.append(np.concatenate([ends, gap]))
        right.append(np.concatenate([gap, ends]))
    out = []
    for q in range(1, k + 1):     # q rows, some from either side: the farther of the two outermost
        best = np.minimum(left[q - 1], right[q - 1])
        for i in range(1, q):
            best = np.minimum(best, np.maximum(left[i - 1], right[q - i - 1]))
        out.append(best)
    return out


def _search(keys: Sequence[str], labelings: int, k: int):
    """How many rows lie as near as a row's k-th neighbor: counts of rows by that number, and the two ends of rows left open."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
    names = ["_k", "m", "n", "ub", "ur", "side", "v", "t"]

    def search(t: pa.Table, h: pa.Table) -> pa.Table:
        pieces: list[list[pa.Array]] = []
        if t.num_rows and h.num_rows:
            x, ys, u = _unpacked(t, labelings)
            bucket = t["_b"][0].as_py()
            h = h.sort_by([("_k", "ascending"), ("c", "ascending")])
            ks = h["_k"].to_numpy()
            starts = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(ks))):
                here = h.slice(lo, hi - lo).combine_chunks()
                j, before, total = int(ks[lo]), here["before"][0].as_py(), here["total"][0].as_py()
                codes = ys[j - 1]
                at = np.flatnonzero(codes >= 0)
                num, codes = x[at], codes[at]
                cls, kk = here["c"].to_numpy(), np.minimum(k, here["ny"].to_numpy() - 1)
                outer = []
                for side in ("left", "right"):          # nearest first
                    lists = here[side].combine_chunks()
                    outer.append((lists.flatten().to_numpy(), np.repeat(cls, lists.value_lengths().to_numpy()).astype(codes.dtype)))
                (lx, lc), (rx, rc) = outer
                every, same = np.concatenate([lx[::-1], num, rx]), np.concatenate([lc[::-1], codes, rc])
                by = np.argsort(same, kind="stable")
                same = same[by]
                dist = _kth(every[by], same, k)
                if (kk == k).all():
                    r = dist[k - 1]
                else:
                    r = np.choose(kk[np.searchsorted(cls, same)] - 1, dist)
                own = (by >= len(lx)) & (by < len(lx) + len(num))
                reach = np.empty(len(num))
                # A little less than the k-th distance, so that rounding cannot pull that row in.
                reach[by[own] - len(lx)] = r[own] * (1 - 1e-10)
                low, high = num - reach, num + reach
                under, upto = np.searchsorted(num, low, "left"), np.searchsorted(num, high, "right")
                open_low = (low < x[0]) & (before > 0)
                open_high = (high > x[-1]) & (before + len(num) < total)
                loose = open_low | open_high
                if len(u):
                    loose |= u[at] != 0
                met = np.bincount((upto - under)[~loose])
                m = np.flatnonzero(met)
                none = pa.nulls(len(m))
                pieces.append([pa.array(np.full(len(m), j)), pa.array(m), pa.array(met[m]), *[none] * 5])
                w = np.flatnonzero(loose)
                if len(w):
                    again = u[at[w]] != 0 if len(u) else np.zeros(len(w), bool)
                    ub = np.where(again, -1, bucket)
                    ur = np.where(again, u[at[w]] if len(u) else 0, at[w])
                    none = pa.nulls(len(w))
                    for side, v, count, opened in ((-1, low, under, open_low), (1, high, upto, open_high)):
                        pieces.append([pa.array(np.full(len(w), j)), none, none, pa.array(ub), pa.array(ur), pa.array(np.full(len(w), side)),
                                       pa.array(v[w], mask=~opened[w]), pa.array(side * (before + count[w]), mask=opened[w])])
        columns = [pa.concat_arrays([pa.array([], d), *[p[i].cast(d) for p in pieces]]) for i, d in enumerate(types)]
        fixed = [pa.array([t[c][0].as_py()] * len(columns[0]) if pieces else [], (t if t.num_rows else h).schema.field(c).type) for c in keys]
        return pa.Table.from_arrays([*fixed, *columns], names=[*keys, *names])
    return search


def _close(keys: Sequence[str], labelings: int):
    """Count the rows below the open ends that fall into a bucket."""
    def close(t: pa.Table, e: pa.Table) -> pa.Table:
        ks, v, side = e["_k"].to_numpy(), e["v"].to_numpy(), e["side"].to_numpy()
        found = np.zeros(len(ks), np.int64)
        if t.num_rows and len(ks):
            x, ys, _ = _unpacked(t, labelings)
            for j in np.unique(ks):
                num = x[ys[j - 1] >= 0]
                for s, where in ((-1, "left"), (1, "right")):
                    w = np.flatnonzero((ks == j) & (side == s))
                    found[w] = np.searchsorted(num, v[w], where)
        return e.select([*keys, "_k", "ub", "ur"]).append_column("t", pa.array(side * (e["before"].to_numpy() + found), pa.int64()))
    return close


def near_counts(points: DataFrame, keys: Sequence[str], splits: Splits, labelings: int, k: int) -> tuple[DataFrame, DataFrame]:
    """How many rows of any class lie within a row's k-th nearest distance in its class, under every labeling.

    ``points`` is (keys..., x, ys, u): a number, the class codes of the row by labeling (-1: left out of it) and 0, or a number that
    rows of one repeated id share; such rows are added up. No class has a single row. The first result is (keys..., _k, m, n): n rows
    see m rows, themselves included, in labeling _k; the second (keys..., _k, c, ny): rows of each class.
    """
    keys = list(keys)
    types = {f.name: f.dataType for f in points.schema.fields}
    fixed = [T.StructField(c, types[c]) for c in keys]

    def schema(columns: str) -> T.StructType:
        return T.StructType(fixed + T.StructType.fromDDL(columns).fields)

    bucketed = splits.bucketed(points, "x").select(*keys, "_b", "x", "ys", "u")
    kept = cut_lineage(bucketed.groupBy(*keys, "_b").applyInArrow(_pack(keys, labelings, k), schema(
        "_b int, _k int, c int, n long, f array<double>, l array<double>, x binary, y binary, u binary")))
    packed = kept.where("x is not null").select(*keys, "_b", "x", "y", "u").groupBy(*keys, "_b")
    # toDF names the columns anew, so that both parts of the table can meet again
    edges = kept.toDF(*kept.columns).where("_k is not null").select(*keys, "_b", "_k", "c", "n", "f", "l")

    # rows in earlier buckets, for every bucket an end can fall into
    top = 2 * (2**splits.steps - 1) + 1 if splits.table is not None else 0
    there = edges.groupBy(*keys, "_k", "_b").agg(F.sum("n").alias("n"))
    grid = there.select(*keys, "_k").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(top))))
    order = W.partitionBy(*keys, "_k").orderBy("_b")
    sums = grid.join(there, [*keys, "_k", "_b"], "left").select(
        *keys, "_k", "_b", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))

    # every bucket that has a class gives at least one number, so k buckets always reach far enough
    own = W.partitionBy(*keys, "_k", "c").orderBy("_b")
    no = F.array().cast("array<double>")
    left = F.concat(*[F.reverse(F.coalesce(F.lag("l", i).over(own), no)) for i in range(1, k + 1)])
    right = F.concat(*[F.coalesce(F.lead("f", i).over(own), no) for i in range(1, k + 1)])
    halo = edges.select(*keys, "_b", "_k", "c", F.slice(left, 1, k).alias("left"), F.slice(right, 1, k).alias("right"),
                        F.sum("n").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("ny"))
    halo = halo.join(sums, [*keys, "_k", "_b"]).groupBy(*keys, "_b")

    found = packed.cogroup(halo).applyInArrow(_search(keys, labelings, k), schema(
        "_k int, m long, n long, ub int, ur long, side int, v double, t long"))
    found = cut_lineage(found)
    ends = found.where("ur is not null")
    closed = ends.where("v is null").select(*keys, "_k", "ub", "ur", "t")
    if splits.table is not None:
        opened = splits.bucketed(ends.where("v is not null"), "v").join(sums.drop("total"), [*keys, "_k", "_b"])
        opened = opened.select(*keys, "_b", "_k", "ub", "ur", "side", "v", "before").groupBy(*keys, "_b")
        closed = closed.unionByName(packed.cogroup(opened).applyInArrow(
            _close(keys, labelings), schema("_k int, ub int, ur long, t long")))
    each = closed.groupBy(*keys, "_k", "ub", "ur").agg(F.sum("t").alias("m")).groupBy(*keys, "_k", "m").agg(F.count(F.lit(1)).alias("n"))
    counts = found.where("m is not null").select(*keys, "_k", "m", "n").unionByName(each)
    return counts, edges.groupBy(*keys, "_k", "c").agg(F.sum("n").alias("ny"))
