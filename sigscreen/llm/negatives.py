"""Hard negatives by cover trees, one per shard of candidates.

Vectors are whole numbers, and a score is their exact inner product. With one more coordinate, sqrt(M - |x|^2), all candidates of a
shard lie on a sphere of radius sqrt(M), M being the largest |x|^2 there; an anchor gets 0. Each level of a cover tree has centers
farther apart than the level's radius, which shrinks by ``BASE`` a level; a node keeps the radius that really covers it. Seen
from the middle, node and anchor are two angles: cos(angle -+ covering angle) bounds all inner products below the node, from both sides.
The descent takes the node with the highest bound first, passes over nodes that lie outside all windows asked for or below what
was found, and works out every row of the leaves it reaches.

Blocks of anchors meet shards in waves of 1, 3, 12, 48 ... shards. A wave knows the best found so far and yields only what beats
it: some four times as many rows a wave as are wanted, however many shards it has.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscreen.llm.corpus import by_key
from sigscreen.runtime import cut_lineage

SHARD = 8192               # candidates in a tree, about
BLOCK = 1024               # anchors searched together, about
LEAF = 64
BASE = 1.3
WIDE = 32                  # centers after which half of a node must be covered, or it stays a leaf
LEAST, MOST = -(2**63), 2**63 - 1


def _bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as got:
        return {k: got[k] for k in got.files}


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The inner products of rows of ``x`` with ``q``, exact; one beyond a long is cut to it."""
    largest = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    if largest * max(x.shape[1], 1) < 2.0**53:
        return (x.astype(np.float64, copy=False) @ q.astype(np.float64, copy=False)).astype(np.int64)
    big = x.astype(object) @ q.astype(object)
    return np.array([min(MOST, max(LEAST, int(s))) for s in big], np.int64)


def one_of_each(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
    """Rows by id; of those that share an id, that with the least label, then the least vector."""
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*vectors.T[::-1], labels, ids))
        order = order[np.append(True, np.diff(ids[order]) > 0)]
    return ids[order], labels[order], vectors[order]


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree as arrays: node i has center[i], radius[i], rows lo[i]..hi[i] and nodes first[i]..last[i] below it (none: a leaf)."""
    ids, labels, vectors = one_of_each(ids, labels, vectors)
    points = vectors.astype(np.float64)
    norms = (points * points).sum(axis=1)
    flat = np.concatenate([points, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)

    def distance(rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((flat[rows] - flat[center]) ** 2).sum(axis=1))

    def cover(rows: np.ndarray, far: np.ndarray, center: int, radius: float):
        """Centers farther apart than ``radius``, each with the rows it covers; none where they would hardly be fewer than the rows."""
        out, left = [(center, rows[far <= radius], far[far <= radius])], rows[far > radius]
        while len(left):
            if len(out) == WIDE and 2 * len(left) > len(rows):
                return []
            d = distance(left, left[0])
            out.append((left[0], left[d <= radius], d[d <= radius]))
            left = left[d > radius]
        return out

    every = np.arange(len(ids))
    nodes = {k: [] for k in ("center", "radius", "lo", "hi", "first", "last", "least", "most")}
    order = np.empty(len(ids), np.int64)

    def enter(center: int, rows: np.ndarray, far: np.ndarray, lo: int) -> None:
        for k, v in zip(nodes, (center, far.max(), lo, lo + len(rows), 0, 0, labels[rows].min(), labels[rows].max())):
            nodes[k].append(v)

    enter(0, every, distance(every, 0), 0)
    todo = [(0, every, distance(every, 0))]
    while todo:
        me, rows, far = todo.pop()
        radius, lo = nodes["radius"][me], nodes["lo"][me]
        below = cover(rows, far, nodes["center"][me], radius / BASE) if len(rows) > LEAF and radius > 0 else []
        if not below:
            order[lo:lo + len(rows)] = rows
            continue
        nodes["first"][me], nodes["last"][me] = len(nodes["lo"]), len(nodes["lo"]) + len(below)
        for center, own, d in below:
            todo.append((len(nodes["lo"]), own, d))
            enter(center, own, d, lo)
            lo += len(own)
    tree = {k: np.array(v) for k, v in nodes.items()}
    tree["center"] = points[tree["center"]]
    return tree | {"ids": ids[order], "labels": labels[order], "vectors": vectors[order], "size": np.array(np.sqrt(norms.max()))}


class Search:
    """A block of anchors before one tree."""

    def __init__(self, tree: dict[str, np.ndarray], anchors: dict[str, np.ndarray]):
        self.tree, self.anchors = tree, anchors
        self.at = {int(i): k for k, i in enumerate(anchors["ids"])}
        q, size = anchors["vectors"].astype(np.float64), float(tree["size"])
        reach = np.sqrt((q * q).sum(axis=1)) * size
        angle = np.arccos(np.clip(q @ tree["center"].T / np.where(reach > 0, reach, 1)[:, None], -1, 1))
        cover = 2 * np.arcsin(np.clip(tree["radius"] / (2 * size if size else 1), 0, 1))
        slack = 1e-6 * (1 + reach)[:, None]            # arccos loses half the digits near 0
        self.above = reach[:, None] * np.cos(np.maximum(angle - cover, 0)) + slack
        self.below = reach[:, None] * np.cos(np.minimum(angle + cover, np.pi)) - slack
        self.leaves = 0

    def run(self, anchor: int, same: bool, windows: list[list], k: int) -> list[list[tuple[int, int]]]:
        """For each window [low, high, bar] the k best (-score, id) of scores in it and not under ``bar``, of rows of the anchor's label or of others."""
        tree, me = self.tree, self.at[anchor]
        label, q = self.anchors["labels"][me], self.anchors["vectors"][me]
        above, below = self.above[me].tolist(), self.below[me].tolist()
        found: list[list[tuple[int, int]]] = [[] for _ in windows]

        def wanted(node: int) -> bool:
            if same and not tree["least"][node] <= label <= tree["most"][node]:
                return False
            if not same and tree["least"][node] == tree["most"][node] == label:
                return False
            return any(below[node] <= high and above[node] >= max(low, bar) for low, high, bar in windows)

        heap = [(-above[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not wanted(node):                        # the bars may have risen since it was put there
                continue
            first, last = tree["first"][node], tree["last"][node]
            if last > first:
                for child in range(first, last):
                    if wanted(child):
                        heapq.heappush(heap, (-above[child], child))
                continue
            self.leaves += 1
            rows = slice(tree["lo"][node], tree["hi"][node])
            score, ids = products(tree["vectors"][rows], q), tree["ids"][rows]
            fits = ((tree["labels"][rows] == label) == same) & (ids != anchor)
            for window, best in zip(windows, found):
                low, high, bar = window
                hit = np.flatnonzero(fits & (score >= max(low, bar)) & (score <= high))
                if len(hit):
                    hit = hit[np.lexsort((ids[hit], -score[hit]))[:k]]
                    best += zip((-score[hit]).tolist(), ids[hit].tolist())
                    best.sort()
                    del best[k:]
                    if len(best) == k:
                        window[2] = max(bar, -best[-1][0])
        return found


def whole(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vec array<long> and dim: floor(scale x) of the components x of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vec"), F.size(v).alias("dim"))


def _packed(rows: DataFrame, size: int, key: str, pack: Callable) -> DataFrame:
    """(dim, key, data): rows dealt by their id into groups of about ``size``, each as one row of bytes."""
    groups = cut_lineage(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("groups")))
    dealt = rows.join(groups, "dim").withColumn(key, F.pmod(F.xxhash64("vec_id"), "groups"))

    def run(batches):
        for group in by_key(batches, ["dim", key]):
            dim = group.column("dim")[0].as_py()
            vectors = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, dim)
            if np.abs(vectors.astype(np.float64)).max(initial=0) < 2**31:
                vectors = vectors.astype(np.int32)
            data = pack(*(group.column(c).to_numpy() for c in ("vec_id", "label")), vectors)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([group.column(key)[0].as_py()], pa.int64()),
                                              pa.array([data], pa.binary())], ["dim", key, "data"])

    return cut_lineage(dealt.select("dim", key, "vec_id", "label", "vec").repartition("dim", key).sortWithinPartitions("dim", key).mapInArrow(
        run, f"dim int, {key} long, data binary"))


def _block(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    return _bytes(**dict(zip(("ids", "labels", "vectors"), one_of_each(ids, labels, vectors))))


WINDOW = "array<struct<anchor:long,positive:long,low:long,high:long,bar:long>>"


def _search(trees: DataFrame, blocks: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, positive, other and score: for each window of ``asked`` (anchor, positive, low, high) its k best rows, by waves of shards."""
    spark = trees.sparkSession
    last = trees.agg(F.max("shard")).first()[0]
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    best, lo, hi = None, 0, 1

    def run(batches):
        for batch in batches:
            for data, block, windows in zip(*(batch.column(c) for c in range(3))):
                search, by_anchor = Search(_arrays(data.as_py()), _arrays(block.as_py())), {}
                for w in windows.as_py():
                    by_anchor.setdefault(w["anchor"], []).append(w)
                out = []
                for anchor, own in by_anchor.items():
                    found = search.run(anchor, same, [[w["low"], w["high"], w["bar"]] for w in own], k)
                    out += [(anchor, w["positive"], other, -score) for w, rows in zip(own, found) for score, other in rows]
                columns = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "positive", "other", "score"])

    while last is not None and lo <= last:
        now = asked
        if best is not None:
            bars = best.groupBy("anchor", "positive").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            now = asked.join(bars.drop("n"), ["anchor", "positive"], "left").fillna(LEAST, ["bar"])
        else:
            now = asked.withColumn("bar", F.lit(LEAST).cast("long"))
        # a block has some BLOCK anchors, and an anchor as many windows as positives are asked for
        windows = now.groupBy("dim", "block").agg(F.collect_list(F.struct("anchor", "positive", "low", "high", "bar")).alias("windows"))
        shards = trees.where(F.col("shard").between(lo, hi - 1)).select("dim", "shard", F.col("data").alias("tree"))
        met = blocks.join(windows, ["dim", "block"]).withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(min(hi - 1, last))))).join(
            shards, ["dim", "shard"]).select("tree", "data", "windows")
        found = met.mapInArrow(run, "anchor long, positive long, other long, score long")
        found = found if best is None else best.union(found)
        best = cut_lineage(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"))
        lo, hi = hi, 4 * hi
    if best is None:
        best = spark.createDataFrame([], "anchor long, positive long, other long, score long")
    return best


def hard_negatives(embeddings: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows of (vec_id, embedding, label).

    Components x count as floor(scale x); scores are inner products with the anchor, higher ones first, ties to the smaller
    vec_id. An anchor's positives are its first ``positives`` other rows of its label; of the rows of other labels whose score is between
    ``low`` and ``high`` percent of a positive's, the first ``negatives`` are returned. Rows with a null id, label or vector, or a null,
    NaN or infinite component, take no part; a zero vector does. Of rows that share an id, the one with the least label, then the least vector,
    counts alone. Vectors meet those of their length only. Scores beyond a long are cut to it. Other columns are left out.
    """
    trees = _packed(whole(embeddings, scale), SHARD, "shard", lambda *rows: _bytes(**build(*rows)))
    blocks = _packed(whole(anchors, scale), BLOCK, "block", _block)

    def ids(batches):
        for batch in batches:
            for dim, block, data in zip(*(batch.column(c) for c in range(3))):
                own = _arrays(data.as_py())["ids"]
                yield pa.RecordBatch.from_arrays([pa.array([dim.as_py()] * len(own), pa.int32()), pa.array([block.as_py()] * len(own), pa.int64()),
                                                  pa.array(own, pa.int64())], ["dim", "block", "anchor"])

    asked = cut_lineage(blocks.mapInArrow(ids, "dim int, block long, anchor long"))
    ends = F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high")
    found = _search(trees, blocks, asked.select("*", F.lit(0).cast("long").alias("positive"), *ends), True, positives)
    score = F.col("score")
    # ceil(low s / 100) and floor(high s / 100) without a product that could pass a long
    hundreds = F.expr("score div 100") - F.expr("score % 100 < 0").cast("int")
    rest = F.pmod(score, F.lit(100))
    pairs = cut_lineage(asked.join(found.select("anchor", F.col("other").alias("positive"), "score"), "anchor").select(
        "dim", "block", "anchor", "positive", "score",
        (hundreds * low + F.ceil(rest * low / 100)).alias("low"), (hundreds * high + F.floor(rest * high / 100)).alias("high")))
    best = _search(trees, blocks, pairs.drop("score"), False, negatives)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    return best.withColumn("rank", F.row_number().over(order)).withColumnRenamed("score", "negative_score").join(
        pairs.select("anchor", "positive", F.col("score").alias("positive_score")), ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", "negative_score")
