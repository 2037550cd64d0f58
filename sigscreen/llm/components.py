"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sigscreen.runtime import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of the links (a, b); component is the least node reached.

    Each round hangs neighbors below the least node near them, first the larger ones, then the
    smaller ones; it stops when the links no longer change. Every row is one link, written
    once a round, and no group is gathered: a group only yields its least member.
    """
    edges, now = _written(links.select("a", "b"))
    before = None
    while now != before:
        before = now
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbors of a node move to the least node near it
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # smaller neighbors, and the node itself, move to its least neighbor
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        edges, now = _written(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .union(least.select("a", F.col("m").alias("b"))))
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return down.union(down.select(F.col("component").alias("node"), "component")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The different links, written, with their number and a sum of their hashes as seen while writing."""
    seen = Observation()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    out = cut_lineage(edges.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")))
    return out, (seen.get["n"], seen.get["mark"])
