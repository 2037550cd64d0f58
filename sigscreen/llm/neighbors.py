"""Nearest neighbors by vantage-point trees, one per shard.

Largest inner product becomes least distance with one more coordinate: a vector x of a shard gets
sqrt(M - |x|^2), a query 0, M being the largest |x|^2 there. A tree node holds a vantage point and the median
distance to it; the triangle inequality tells which side cannot hold a nearer vector. The bound
is relaxed by a factor: with 1 the search is exact, with more it skips sides that could only help a little.

Shards and blocks of queries have a bounded size. Every block meets every shard, as a row of bytes, in waves of 1, 3, 12, 48 ...
shards. A wave knows each query's k-th best so far and yields only what reaches it: some 4 k rows a query and wave
are expected, however many shards the wave has.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscreen.llm.corpus import by_key
from sigscreen.runtime import cut_lineage

SHARD = 4096               # vectors in a tree, about
BLOCK = 1024               # queries searched together, about
LEAF = 64


def _bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as got:
        return {k: got[k] for k in got.files}


def build(ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 1) -> dict[str, np.ndarray]:
    """A tree over the distinct vectors; of equal ones the k + 1 smallest ids can be among the k nearest of a query."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, head, group = np.unique(rows, return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    size = np.bincount(group)
    begin = np.cumsum(size) - size
    rank = np.arange(len(ids)) - np.repeat(begin, size)
    kept = by_group[rank <= k]
    copies = np.minimum(size, k + 1)
    points = vectors[head].astype(np.float64)
    norms = (points * points).sum(axis=1)
    lift = np.sqrt(np.maximum(norms.max() - norms, 0))
    flat = np.concatenate([points, lift[:, None]], axis=1)

    place = np.arange(len(points))
    rng = np.random.default_rng(seed)
    node_point, radius, left, right, lo, hi = [], [], [], [], [], []

    def grow(a: int, b: int) -> int:
        me = len(radius)
        for column, value in ((node_point, -1), (radius, 0.0), (left, -1), (right, -1), (lo, a), (hi, b)):
            column.append(value)
        if b - a > LEAF:
            vantage = place[a + int(rng.integers(b - a))]
            d = np.sqrt(((flat[place[a:b]] - flat[vantage]) ** 2).sum(axis=1))
            near = np.argsort(d, kind="stable")
            place[a:b] = place[a:b][near]
            middle = (b - a) // 2
            node_point[me], radius[me] = vantage, d[near[middle - 1]]
            left[me] = grow(a, a + middle)
            right[me] = grow(a + middle, b)
        return me

    grow(0, len(place))
    return {"points": vectors[head], "place": place, "lift": lift, "node_point": np.array(node_point), "radius": np.array(radius),
            "left": np.array(left), "right": np.array(right), "lo": np.array(lo), "hi": np.array(hi),
            "ids": ids[kept], "first": np.append(0, np.cumsum(copies))}


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component on."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d].astype(np.float64) * x[:, d].astype(np.float64)
    return out


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float, bar: np.ndarray):
    """(query, vec_id, score) of the k best of the tree for each query, the query's own row and scores under its ``bar`` left out."""
    points, place, lift = tree["points"], tree["place"], tree["lift"]
    wide, q = points.astype(np.float64), queries.astype(np.float64)
    top = float((wide * wide).sum(axis=1).max())
    length = (q * q).sum(axis=1)
    n = len(q)
    best = np.full((n, k), -np.inf)
    who = np.full((n, k), np.iinfo(np.int64).max)
    eps = 1e-9 * (1 + np.sqrt(length * top))
    floor = bar.copy()
    seeded = np.full(n, -1)

    def visit(node: int, active: np.ndarray) -> None:
        members = place[tree["lo"][node]:tree["hi"][node]]
        near = q[active] @ wide[members].T
        row, col = np.nonzero(near >= (floor[active] - eps[active])[:, None])
        if not len(row):
            return
        copies = np.diff(tree["first"])[members[col]]
        start = np.repeat(tree["first"][:-1][members[col]], copies)
        inner = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        score = exact_products(queries[active[row]], points[members[col]])
        row, score, ids = np.repeat(active[row], copies), np.repeat(score, copies), tree["ids"][start + inner]
        other = ids != query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        if not len(row):
            return
        hit = np.unique(row)
        row = np.concatenate([row, np.repeat(hit, k)])
        score = np.concatenate([score, best[hit].ravel()])
        ids = np.concatenate([ids, who[hit].ravel()])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        at = begin[:, None] + np.arange(k)
        best[hit], who[hit] = score[at], ids[at]
        floor[hit] = np.maximum(bar[hit], best[hit, -1])

    def distance(node: int, active: np.ndarray) -> np.ndarray:
        v = tree["node_point"][node]
        square = length[active] + top - 2 * (q[active] @ wide[v])
        # the query has no lift: |q - x|^2 + (0 - lift)^2 = |q|^2 + M - 2 q x
        return np.sqrt(np.maximum(square, 0))

    todo = [(0, np.arange(n))]
    while todo:                                     # first each query's own leaf
        node, active = todo.pop()
        if tree["left"][node] < 0:
            seeded[active] = node
            visit(node, active)
            continue
        near = distance(node, active) <= tree["radius"][node]
        todo += [(c, a) for c, a in ((tree["left"][node], active[near]), (tree["right"][node], active[~near])) if len(a)]
    todo = [(0, np.arange(n))]
    while todo:                                     # then all leaves that the bound leaves open
        node, active = todo.pop()
        if tree["left"][node] < 0:
            active = active[seeded[active] != node]
            if len(active):
                visit(node, active)
            continue
        d, r = distance(node, active), tree["radius"][node]
        reach = np.sqrt(np.maximum(length[active] + top - 2 * (floor[active] - 2 * eps[active]), 0)) / relax
        slack = 1e-9 * (1 + d)
        inside, outside = d - r <= reach + slack, r - d <= reach + slack
        todo += [(c, a) for c, a in ((tree["right"][node], active[outside]), (tree["left"][node], active[inside])) if len(a)]
    row, col = np.nonzero((best > -np.inf) & (best >= bar[:, None]))
    return query_ids[row], who[row, col], best[row, col]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec, dim) of the vectors that take part; single precision stays so, all else is taken as double."""
    single = embeddings.schema["embedding"].dataType.elementType.typeName() == "float"
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("vec"))


def _packed(rows: DataFrame, key: str, pack) -> DataFrame:
    """(dim, key, data): the vectors of each group as one row of bytes."""
    def run(batches):
        for group in by_key(batches, ["dim", key]):
            dim = group.column("dim")[0].as_py()
            flat = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            data = pack(group.column("vec_id").to_numpy(), flat.reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([group.column(key)[0].as_py()], pa.int64()),
                                              pa.array([data], pa.binary())], ["dim", key, "data"])

    return rows.select("dim", key, "vec_id", "vec").repartition("dim", key).sortWithinPartitions("dim", key).mapInArrow(
        run, f"dim int, {key} long, data binary")


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with a group number, so that groups hold about ``size`` rows of one dimension."""
    groups = cut_lineage(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("groups")))
    return rows.join(F.broadcast(groups), "dim").withColumn(name, F.pmod(F.xxhash64("vec_id"), "groups"))


def index(embeddings: DataFrame, k: int) -> DataFrame:
    """(dim, shard, data): the tree of each shard, for up to k neighbors. Every usable row is in one."""
    return _packed(_dealt(usable(embeddings), SHARD, "shard"), "shard", lambda ids, v: _bytes(**build(ids, v, k)))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, relax: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of (vec_id, embedding) for each query row of the same form.

    Nearness is the largest inner product in double precision, ties to the smaller vec_id; a row is
    no neighbor of its own id. Vectors that are null, zero, or hold null, NaN or infinite components
    take no part, nor do null ids; vectors meet others of their length only. A row that stands twice counts once as a query and
    may be found twice. With ``relax`` = 1 the answer is exact. Other columns are left out.
    """
    trees = cut_lineage(index(embeddings, k))
    asked = usable(queries).dropDuplicates(["vec_id"])
    dealt = cut_lineage(_dealt(asked, BLOCK, "block"))
    blocks = cut_lineage(_packed(dealt, "block", lambda ids, v: _bytes(ids=ids, vectors=v)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def run(batches):
        for batch in batches:
            for tree, asked, bars in zip(*(batch.column(c) for c in range(3))):
                q = _arrays(asked.as_py())
                bar = np.full(len(q["ids"]), -np.inf)
                place = {int(i): at for at, i in enumerate(q["ids"])}
                for b in bars.as_py() or ():
                    bar[place[b["query_id"]]] = b["bar"]
                found = search(_arrays(tree.as_py()), q["ids"], q["vectors"], k, relax, bar)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    last = trees.agg(F.max("shard")).first()[0]
    best, lo, hi = None, 0, 1
    while last is not None and lo <= last:
        wave = blocks.withColumn("bars", F.lit(None).cast("array<struct<query_id:long,bar:double>>"))
        if best is not None:
            bars = best.groupBy("query_id").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            bars = dealt.select("dim", "block", F.col("vec_id").alias("query_id")).join(bars, "query_id").groupBy("dim", "block").agg(
                F.collect_list(F.struct("query_id", "bar")).alias("bars"))          # a block has some BLOCK queries
            wave = blocks.join(bars, ["dim", "block"], "left")
        wave = wave.select("dim", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(hi - 1, last)).cast("long"))).alias("shard"),
                           F.col("data").alias("asked"), "bars")
        met = trees.where(F.col("shard").between(lo, hi - 1)).join(wave, ["dim", "shard"]).select("data", "asked", "bars")
        found = met.mapInArrow(run, "query_id long, vec_id long, score double")
        found = found if best is None else best.union(found)
        best = cut_lineage(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"))
        lo, hi = hi, 4 * hi
    if best is None:
        best = embeddings.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
