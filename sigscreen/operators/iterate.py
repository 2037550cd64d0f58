"""Iterative graph operators as rounds of DataFrame joins.

State tables are written to the checkpoint folder between rounds, so a lost executor
repeats at most one round. The hubs of the edge table are found once and salted in
every join of edges to state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions.columns import hash_text
from sigscreen.operators.counts import top_category
from sigscreen.operators.joins import hot_keys, lookup_join
from sigscreen.operators.ordering import hash_positions
from sigscreen.runtime import cut_lineage


def pagerank(edges: DataFrame, src: str, dst: str, rounds: int = 10,
             damping: float = 0.85) -> DataFrame:
    """(id, pagerank) over directed edges weighted by multiplicity, after fixed rounds.

    Nodes without out-edges share their rank evenly among all nodes; ranks sum to 1.
    """
    arcs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(
        F.col(src).alias("a"), F.col(dst).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    arcs = cut_lineage(arcs)
    sums = arcs.groupBy("a").agg(F.sum("w").alias("_out"))
    hot = hot_keys(arcs, "a")
    shares = cut_lineage(lookup_join(arcs, sums, "a", "inner", hot).select(
        "a", "b", (F.col("w") / F.col("_out")).alias("p")))
    nodes = cut_lineage(arcs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    n = nodes.count()
    ranks = nodes.withColumn("pagerank", F.lit(1.0 / n) if n else F.lit(0.0))
    for _ in range(rounds):
        state = ranks.withColumnRenamed("id", "a")
        gains = lookup_join(shares, state, "a", "inner", hot).groupBy(
            F.col("b").alias("id")).agg(F.sum(F.col("p") * F.col("pagerank")).alias("_in"))
        gains = cut_lineage(nodes.join(gains, "id", "left").select(
            "id", F.coalesce(F.col("_in"), F.lit(0.0)).alias("_in")))
        # What the arcs did not carry is the rank of nodes without out-edges.
        lost = 1.0 - (gains.agg(F.sum("_in")).first()[0] or 0.0)
        ranks = gains.select("id", (
            F.lit((1.0 - damping) / max(n, 1) + damping * lost / max(n, 1))
            + F.lit(damping) * F.col("_in")).alias("pagerank"))
    return ranks


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component): the smallest id of each component.

    Each round takes the smallest label among neighbors, hands it to everyone with the
    same label, and then jumps to the label of the label, so a chain of n nodes needs
    about log n rounds. It ends when a round changes nothing.
    """
    both = F.explode(F.array(
        F.struct(F.col(src).alias("a"), F.col(dst).alias("b")),
        F.struct(F.col(dst).alias("a"), F.col(src).alias("b"))))
    arcs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        both.alias("_e")).select("_e.*")
    nodes = arcs.select(F.col("a").alias("id")).distinct()
    arcs = cut_lineage(arcs.where("a <> b").distinct())
    hubs = hot_keys(arcs, "b")
    labels = cut_lineage(nodes.withColumn("component", F.col("id")))
    crowded: list = []
    while True:
        state = labels.select(F.col("id").alias("b"), F.col("component").alias("_nb"))
        near = lookup_join(arcs, state, "b", "inner", hubs).groupBy(
            F.col("a").alias("id")).agg(F.min("_nb").alias("_nb"))
        seen = labels.join(near, "id", "left").select(
            "id", "component", F.least("component", "_nb").alias("_m"))
        # The smallest label seen by any member of a label group.
        best = seen.groupBy("component").agg(F.min("_m").alias("_best"))
        hooked = cut_lineage(lookup_join(seen, best, "component", "left", crowded).select(
            "id", "component", F.col("_best").alias("_new")))
        jump = hooked.select(F.col("id").alias("_new"), F.col("_new").alias("_root"))
        crowd = hot_keys(hooked, "_new")
        after = cut_lineage(lookup_join(hooked, jump, "_new", "left", crowd).select(
            "id", F.col("component").alias("_old"),
            F.least("_new", "_root").alias("component")))
        changed = after.where("_old <> component").limit(1).count()
        labels = after.select("id", "component")
        crowded = hot_keys(labels, "component")
        if not changed:
            return labels


def label_propagation(pairs: DataFrame, folds: DataFrame, id_col: str, label: str,
                      rounds: int = 3, hot: list | None = None) -> DataFrame:
    """(id, lp_label): label spread along edges, with each entity's own fold hidden from it.

    One run per fold, all in one table: run r starts from the labels of the other folds
    and an entity reads the run of its own fold. Unlabeled ones read the run that
    starts from all labels. Seeds keep their label; the others take the most frequent
    label among their neighbors, the smallest on a tie.
    """
    if "fold" not in folds.columns:
        raise ValueError("labels are only read together with folds")
    ids = folds.select(F.col(id_col).alias("id"), F.col(label).alias("_lab"), "fold")
    runs = [r.fold for r in ids.select("fold").distinct().orderBy("fold").collect()]
    every = F.explode(F.array(*[F.lit(r) for r in runs])).alias("run")
    seeds = ids.where("_lab is not null").select("id", "_lab", "fold", every).where(
        "run <> fold").select("run", "id", "_lab")
    seeds = cut_lineage(seeds)
    multi = pairs.where("b is not null").select(
        "a", "b", (F.col("out_n") + F.col("in_n")).alias("n"))
    multi = cut_lineage(multi)
    hot = hot_keys(multi, "b") if hot is None else hot
    state = seeds
    for _ in range(rounds):
        # (b) is not unique in the state: at most one row per run, so salting still applies.
        near = lookup_join(multi, state.withColumnRenamed("id", "b"), "b", "inner", hot)
        votes = near.groupBy("run", F.col("a").alias("id"), "_lab").agg(F.sum("n").alias("n"))
        won = votes.groupBy("run", "id").agg(top_category("_lab", "n").alias("_won"))
        state = cut_lineage(won.join(seeds, ["run", "id"], "full").select(
            "run", "id", F.coalesce("_lab", "_won").alias("_lab")))
    own = ids.select("id", F.col("fold").alias("run"))
    return state.join(own, ["id", "run"]).select(
        F.col("id").alias(id_col), F.col("_lab").alias("lp_label"))


def random_walks(pairs: DataFrame, length: int = 4, per_node: int = 2,
                 seed: int = 0) -> DataFrame:
    """(id, walk, path): ``per_node`` walks from each node, every step to a hashed neighbor.

    Neighbors are numbered, so a step joins on (node, number). The walkers that stand
    on a hub are spread over its neighbors.
    """
    arcs = pairs.where("b is not null").select("a", "b")
    numbered = hash_positions(arcs, ["a", "b"], ["a"], seed, "pos")
    degs = arcs.groupBy("a").agg(F.count("b").alias("deg"))
    hot = hot_keys(arcs, "b")
    steps = lookup_join(numbered, degs.select(F.col("a").alias("b"), F.col("deg").alias("b_deg")),
                        "b", "inner", hot)
    steps = cut_lineage(steps.select("a", "pos", F.col("b").alias("_to"), "b_deg"))
    walkers = degs.select(
        F.col("a").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"),
        F.col("a").alias("_at"), "deg", F.array("a").alias("path"))
    for i in range(1, length + 1):
        draw = F.conv(F.substring(hash_text(seed, "id", "walk", F.lit(i)), 1, 12), 16, 10)
        pick = (F.pmod(draw.cast("bigint"), F.col("deg")) + 1).alias("pos")
        walkers = walkers.select("*", pick).withColumnRenamed("_at", "a").join(
            steps, ["a", "pos"]).select(
            "id", "walk", F.col("_to").alias("_at"), F.col("b_deg").alias("deg"),
            F.concat("path", F.array("_to")).alias("path"))
    return walkers.select("id", "walk", "path")


def walk_embeddings(walks: DataFrame, dim: int = 16, window: int = 2, max_nodes: int | None = None,
                    seed: int = 0) -> DataFrame:
    """(id, embedding) of each node from its walks: ``projected_embeddings`` at every size.

    ``max_nodes`` has no effect; it is left for callers that pass it.
    """
    return projected_embeddings(walks, dim, window, seed)


def projected_embeddings(walks: DataFrame, dim: int = 16, window: int = 2,
                         seed: int = 0) -> DataFrame:
    """(id, embedding): mean of hashed sign vectors over all nodes within ``window`` steps."""
    at = walks.select("path", F.posexplode("path").alias("i", "id"))
    # At most 2 x window neighbors per step; the walk itself is of fixed length.
    lo = F.greatest(F.col("i") - window, F.lit(0))
    near = F.slice("path", lo + 1, F.lit(2 * window + 1) - (window - (F.col("i") - lo)))
    pairs = at.select("id", F.explode(near).alias("other")).where("id <> other")
    counts = pairs.groupBy("id", "other").agg(F.count(F.lit(1)).alias("n"))
    sign = [
        F.when(F.substring(hash_text(f"{seed}.{d}", "other"), 1, 1) < "8", 1.0).otherwise(-1.0)
        for d in range(dim)
    ]
    sums = counts.groupBy("id").agg(
        *[(F.sum(F.col("n") * s) / F.sum("n")).alias(f"_{d}") for d, s in enumerate(sign)])
    return sums.select(F.col("id").cast("string").alias("id"), F.array(
        *[F.col(f"_{d}") for d in range(dim)]).alias("embedding"))
