"""Edge features. All start from one table of (a, b) pairs with both message counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.operators.counts import entropy_of, summarise_counts
from sigscreen.operators.joins import lookup_join
from sigscreen.runtime import cut_lineage


def pair_counts(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b, out_n, in_n): messages a sent to b, and b to a. Each pair appears from both ends.

    One scan and one shuffle. Repeated edges are counted before the shuffle, and the
    pair key spreads the edges of a hub over all partitions.
    """
    def end(a: str, b: str, out: int):
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"),
                        F.lit(out).alias("out"), F.lit(1 - out).alias("into"))

    both = edges.select(F.explode(F.array(end(src, dst, 1), end(dst, src, 0))).alias("_e"))
    return both.select("_e.*").where("a is not null").groupBy("a", "b").agg(
        F.sum("out").alias("out_n"), F.sum("into").alias("in_n"))


def _degree_columns():
    return [F.sum("out_n").cast("bigint").alias("deg_out"),
            F.sum("in_n").cast("bigint").alias("deg_in"),
            F.count("b").alias("deg_total")]


def _reciprocity_column():
    contact = (F.col("out_n") > 0) & F.col("b").isNotNull()
    wrote_back = F.when(contact, (F.col("in_n") > 0).cast("double"))
    return F.coalesce(F.avg(wrote_back), F.lit(0.0)).alias("reciprocity")


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Messages sent and received, and distinct counterparties, as columns of ``a``."""
    return pair_counts(edges, src, dst).groupBy("a").agg(*_degree_columns())


def reciprocity(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Share of distinct contacts that wrote back; 0 for one who wrote to nobody.

    The pair row holds both directions, so no join of the edges to themselves is needed.
    """
    return pair_counts(edges, src, dst).groupBy("a").agg(_reciprocity_column())


def graph_block(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(*_degree_columns(), _reciprocity_column())


def oof_neighbor_labels(pairs: DataFrame, folds: DataFrame, id_col: str, label: str,
                        modal: str = "nb_modal", hot: list | None = None) -> DataFrame:
    """Label mix among neighbors of another fold: modal label, share, entropy, labeled share.

    ``folds`` has every entity once, with -1 as the fold of unlabeled ones: they see
    all labeled neighbors, and an entity never sees its own fold's labels. The labeled
    share divides messages by distinct neighbors, so it can exceed 1.
    """
    if "fold" not in folds.columns:
        raise ValueError("labels are only read together with folds")
    known = folds.where(F.col(label).isNotNull()).select(
        F.col(id_col).alias("b"), F.col(label).alias("_lab"), F.col("fold").alias("_b_fold"))
    own = folds.select(F.col(id_col).alias("a"), F.col("fold").alias("_a_fold"))
    multi = pairs.select("a", "b", (F.col("out_n") + F.col("in_n")).alias("n"))
    # After this step a hub has at most classes x folds rows.
    mix = lookup_join(multi, known, "b", "inner", hot).groupBy("a", "_lab", "_b_fold").agg(
        F.sum("n").alias("n"))
    seen = mix.join(own, "a").where("_a_fold <> _b_fold").groupBy("a", "_lab").agg(
        F.sum("n").alias("n"))
    stats = summarise_counts(seen, "a", "_lab", modal, f"{modal}_frac", f"{modal}_entropy",
                             total="_kept")
    degree = pairs.groupBy("a").agg(F.count("b").alias("_deg"))
    return stats.join(degree, "a").select(
        F.col("a").alias(id_col), modal, f"{modal}_frac", f"{modal}_entropy",
        (F.col("_kept") / F.greatest(F.col("_deg"), F.lit(1))).alias(f"{modal}_labeled_frac"))


def edge_ratios(pairs: DataFrame) -> DataFrame:
    """In/out ratio, and number and entropy of counterparties."""
    return pairs.where("b is not null").withColumn(
        "n", F.col("out_n") + F.col("in_n")).groupBy("a").agg(
        (F.sum("in_n") / F.greatest(F.sum("out_n"), F.lit(1))).alias("in_out_ratio"),
        F.count("b").alias("partners"),
        entropy_of("n").alias("partner_entropy"))


def relation_degrees(edges: DataFrame, src: str, dst: str, rel: str,
                     relations: Sequence[str]) -> DataFrame:
    """Per entity and relation: messages and distinct counterparties, one column pair each."""
    sides = F.explode(F.array(
        F.struct(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(rel).alias("rel")),
        F.struct(F.col(dst).alias("a"), F.col(src).alias("b"), F.col(rel).alias("rel"))))
    counts = edges.select(sides.alias("_e")).select("_e.*").where(
        "a is not null and b is not null").groupBy("a", "b", "rel").agg(
        F.count(F.lit(1)).alias("n"))
    out = []
    for r in relations:
        here = F.col("rel") == r
        out.append(F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).cast("bigint")
                   .alias(f"{r}_n"))
        out.append(F.count(F.when(here, F.col("b"))).alias(f"{r}_partners"))
    return counts.groupBy("a").agg(*out)


def union_relations(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Several edge tables as one (src, dst, rel) table."""
    parts = [df.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(rel).alias("rel"))
             for rel, (df, s, d) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def neighbor_mean(pairs: DataFrame, attrs: DataFrame, id_col: str, cols: Sequence[str],
                  prefix: str = "nb_mean_", hot: list | None = None) -> DataFrame:
    """Mean of numeric attributes over the distinct neighbors."""
    known = attrs.select(F.col(id_col).alias("b"), *cols)
    joined = lookup_join(pairs.select("a", "b").where("b is not null"), known, "b", "inner", hot)
    return joined.groupBy("a").agg(*[F.avg(c).alias(prefix + c) for c in cols])


def role_features(pairs: DataFrame, rounds: int = 2, hot: list | None = None) -> DataFrame:
    """Recursive neighbor means of the degree columns, a structural role signature.

    Column ``r2_r1_deg_out`` is the mean over neighbors of their mean neighbor out-degree.
    """
    frame = cut_lineage(pairs.groupBy("a").agg(*_degree_columns()))
    cols = [c for c in frame.columns if c != "a"]
    last = cols
    for i in range(1, rounds + 1):
        means = neighbor_mean(pairs, frame, "a", last, f"r{i}_", hot)
        frame = cut_lineage(frame.join(means, "a", "left"))        # it stands twice in the next round's plan
        last = [f"r{i}_{c}" for c in last]
    return frame
