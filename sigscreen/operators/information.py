"""Feature typing, encoding, mutual information and its permutation null.

Shapes: ``cells`` is long, (groups..., feature, id, x, y); ``counts`` is its contingency
table (groups..., feature, x, y, n). Groups are time slices or permutation numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscreen.functions.columns import digamma, hash_text, to_number, unit_interval, xlogx
from sigscreen.operators.joins import SMALL_BYTES, lookup_join
from sigscreen.operators.nearest import near_counts
from sigscreen.operators.ordering import (
    HASH_DIGITS, ROWS_PER_BUCKET, Splits, exact_quantiles, hash_positions, running_totals)
from sigscreen.runtime import cut_lineage

NUMERIC_ABOVE = 10     # a numeric column with more distinct values is continuous
NEIGHBORS = 3          # the usual k of the nearest-neighbor estimate
BLOCK = 100_000        # not read any more: blocks are the buckets of ``Splits``; callers may still set it


# ---- typing and encoding ------------------------------------------------------

def feature_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, kind): numeric when the type is and more than 10 values occur, else categorical."""
    numeric, categorical = split_kinds(df, cols)
    rows = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string")


def split_kinds(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the categorical columns.

    A sketch settles columns with many values; only those near the limit are counted exactly.
    """
    candidates = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    numeric: set[str] = set()
    if candidates:
        rough = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in candidates]).first()
        near = [c for c in candidates if rough[c] <= 10 * NUMERIC_ABOVE]
        numeric = {c for c in candidates if c not in near}
        if near:
            exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first()
            numeric |= {c for c in near if exact[c] > NUMERIC_ABOVE}
    return [c for c in cols if c in numeric], [c for c in cols if c not in numeric]


def _stacked(values: Sequence[str], names: Sequence[str]):
    """Turn columns of one type into rows (feature, x)."""
    cells = ", ".join(f"struct({_literal(n)} AS feature, `{v}` AS x)"
                      for v, n in zip(values, names))
    return F.expr(f"inline(array({cells}))")


def _literal(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text(df: DataFrame, c: str):
    nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(c) if nested else F.col(c).cast("string")


def numeric_cells(df: DataFrame, id_col: str, label: str, cols: Sequence[str],
                  keep: Sequence[str] = ()) -> DataFrame:
    """Long rows (id, y, keep..., feature, x) of the numeric columns; x may be null."""
    return df.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("y"), *keep,
                     *[to_number(c).alias(f"_x{i}") for i, c in enumerate(cols)]).select(
        "id", "y", *keep, _stacked([f"_x{i}" for i in range(len(cols))], cols))


def category_counts(df: DataFrame, label: str, cols: Sequence[str],
                    groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., feature, x, y, n) of the categorical columns; missing is a category of its own."""
    names = [f"_x{i}" for i in range(len(cols))]
    rows = df.select(*groups, F.col(label).cast("string").alias("y"),
                     *[_text(df, c).alias(n) for n, c in zip(names, cols)])
    return rows.select(*groups, "y", _stacked(names, cols)).groupBy(
        *groups, "feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def impute_median(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Fill missing x with the exact median of its feature (0 when it has no value at all)."""
    keys = [*groups, "feature"]
    medians = exact_quantiles(cells, keys, "x", {"_med": 0.5})
    return cells.join(F.broadcast(medians), keys, "left").withColumn(
        "x", F.coalesce("x", "_med", F.lit(0.0))).drop("_med")


def category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, x, code): codes 1.. for the categories of each column, in hash order."""
    names = [f"_x{i}" for i in range(len(cols))]
    seen = df.select(*[_text(df, c).alias(n) for n, c in zip(names, cols)]).select(
        _stacked(names, cols)).where("x is not null").distinct()
    return hash_positions(seen, ["x"], ["feature"], 0, "code")


def encode_features(df: DataFrame, id_col: str, numeric: Sequence[str],
                    categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide and all numeric: medians for missing numbers, codes from 1 for categories, 0 for missing.

    A column with few categories is coded by a lookup table inside the row; the others
    by a join on the value, with hot values salted.
    """
    out = df.select(id_col, *keep, *[to_number(c).alias(c) for c in numeric],
                    *[_text(df, c).alias(c) for c in categorical])
    if numeric:
        # One number per feature comes back.
        medians = {r["feature"]: r["_med"] for r in exact_quantiles(
            out.select(_stacked(numeric, numeric)), ["feature"], "x", {"_med": 0.5}).collect()}
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c, 0.0)))
                               for c in numeric})
    if categorical:
        codes = category_codes(df, categorical)
        sizes = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        small = [c for c in categorical if sizes.get(c, 0) <= 1000]
        table: dict[str, dict[str, int]] = {c: {} for c in small}
        if small:
            for r in codes.where(F.col("feature").isin(small)).collect():
                table[r["feature"]][r["x"]] = r["code"]
        for c in categorical:
            if c in table:
                pairs = [F.lit(v) for kv in table[c].items() for v in kv]
                code = F.try_element_at(F.create_map(*pairs), F.col(c)) if pairs else F.lit(None)
                out = out.withColumn(c, F.coalesce(code.cast("double"), F.lit(0.0)))
            else:
                coded = codes.where(F.col("feature") == c).select(
                    F.col("x").alias(c), F.col("code").alias("_code"))
                out = lookup_join(out, coded, c, "left").withColumn(
                    c, F.coalesce(F.col("_code").cast("double"), F.lit(0.0))).drop("_code")
    return out.select(id_col, *keep, *numeric, *categorical)


# ---- mutual information ---------------------------------------------------------

def mi_discrete(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., feature, mi) in nats: H(X) + H(Y) - H(X, Y), from sums of n ln n alone."""
    keys = [*groups, "feature"]
    by_x = counts.groupBy(*keys, "x").agg(
        F.sum("n").alias("nx"), F.sum(xlogx("n")).alias("sxy"))
    left = by_x.groupBy(*keys).agg(
        F.sum("nx").alias("N"), F.sum(xlogx("nx")).alias("sx"), F.sum("sxy").alias("sxy"))
    right = counts.groupBy(*keys, "y").agg(F.sum("n").alias("ny")).groupBy(*keys).agg(
        F.sum(xlogx("ny")).alias("sy"))
    mi = F.ln("N") + (F.col("sxy") - F.col("sx") - F.col("sy")) / F.col("N")
    return left.join(right, keys).select(*keys, F.greatest(mi, F.lit(0.0)).alias("mi"))


def _jittered(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Break ties by hashed noise some ten orders below the spread of the feature.

    The size of the noise is a power of two, so that it is the same however the
    spread was summed.
    """
    spread = F.greatest(F.stddev_pop("x"), F.avg(F.abs("x")))
    size = F.when(spread > 0, F.pow(F.lit(2.0), F.round(F.log2(spread * 1e-10)))).otherwise(1e-10)
    keys = [*groups, "feature"]
    sizes = cells.groupBy(*keys).agg(size.alias("_size"))
    noise = unit_interval(hash_text("jitter", "feature", "id")) * 2 - 1
    return cells.join(F.broadcast(sizes), keys).withColumn(
        "x", F.col("x") + F.col("_size") * noise).drop("_size")


def mi_numeric(cells: DataFrame, groups: Sequence[str] = (), k: int = NEIGHBORS,
               parts: int = 1) -> DataFrame:
    """(groups..., feature, mi): nearest-neighbor estimate between a number and a class.

    Ross (2014), PLoS ONE 9(2). For each row, r is the distance to its k-th nearest row
    of the same class and m the number of rows of any class closer than r, itself
    included; MI = psi(N) + <psi(k)> - <psi(N_y)> - <psi(m)>. A class with a single row
    is left out, and k is at most the class size less one.

    Missing x are left out; ``parts`` is the number of groups, when they are about equally large.
    """
    keys = [*groups, "feature"]
    cells = cells.where("x is not null")
    points = _jittered(cells, groups)
    # The noise has spread any heavy value, so split points fall inside it too.
    splits = Splits(points, ["feature"], "x", parts)
    sizes = cut_lineage(cells.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("ny")).where("ny > 1"))
    codes = running_totals(sizes.where("y is not null").withColumn("_one", F.lit(1)), keys, "y", "_one", "_code").select(*keys, "y", "_code")
    # One row per feature, group and class; Spark weighs it and picks the join.
    points = points.join(codes, [*keys, "y"]).withColumn("ys", F.array(F.col("_code").cast("int")))
    # rows of a repeated id are added up
    again = cut_lineage(cells.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if again.isEmpty():
        points = points.withColumn("u", F.lit(0).cast("bigint"))
    else:
        again = again.select(F.struct(*keys, "id").alias("_key"), F.xxhash64("id").alias("_u"))
        points = points.join(again, F.struct(*keys, "id").eqNullSafe(F.col("_key")), "left").withColumn("u", F.coalesce("_u", F.lit(0)))
    unnamed = sizes.where("y is null").select(*keys, F.lit(1).alias("_k"), "ny")
    return _estimate(points, keys, splits, 1, k, unnamed).drop("_k")


def _estimate(points: DataFrame, keys: Sequence[str], splits: Splits, labelings: int, k: int,
              unnamed: DataFrame | None = None) -> DataFrame:
    """(keys..., _k, mi) from points with class codes by labeling.

    ``unnamed`` is (keys..., _k, ny): rows without a class, which count as one among the class sizes but are no one's neighbors.
    """
    counts, sizes = near_counts(points, keys, splits, labelings, k)
    keys = [*keys, "_k"]
    sizes = sizes.drop("c")
    if unnamed is not None:
        sizes = sizes.unionByName(unnamed)
    totals = sizes.groupBy(*keys).agg(
        F.sum("ny").alias("N"),
        (F.sum(F.col("ny") * digamma("ny")) / F.sum("ny")).alias("psi_y"),
        (F.sum(F.col("ny") * digamma(f"least({k}, ny - 1)")) / F.sum("ny")).alias("psi_k"))
    found = counts.groupBy(*keys).agg((F.sum(F.col("n") * digamma("greatest(m, 1)")) / F.sum("n")).alias("psi_m"))
    mi = digamma("N") + F.col("psi_k") - F.col("psi_y") - F.col("psi_m")
    return found.join(totals, keys).select(*keys, F.greatest(mi, F.lit(0.0)).alias("mi"))


def bin_edges(cells: DataFrame, bins: int = 32) -> DataFrame:
    """(feature, edges): approximate quantiles that cut each feature into ``bins`` parts."""
    probs = [i / bins for i in range(1, bins)]
    return cells.groupBy("feature").agg(
        F.array_distinct(F.percentile_approx("x", probs, 10_000)).alias("edges"))


def binned_counts(cells: DataFrame, groups: Sequence[str] = (),
                  bins: int = 32, edges: DataFrame | None = None) -> DataFrame:
    """Contingency table of quantile bins; ``mi_discrete`` of it is the large-data estimate.

    ``edges`` of ``bin_edges`` save a pass where they are known, as under label shuffles, which leave values as they are.
    """
    # One short array per feature.
    rows = cells.join(F.broadcast(bin_edges(cells, bins) if edges is None else edges), "feature")
    b = F.size(F.filter("edges", lambda e: e < F.col("x"))).cast("string")
    return rows.groupBy(*groups, "feature", b.alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))


# ---- permutation null -------------------------------------------------------------

def permuted_labels(df: DataFrame, id_col: str, label: str, perms: int, seed: int = 0) -> DataFrame:
    """Add (k, permuted label) rows for k = 1..perms; ids are unique and labels not null. Any number of classes.

    In permutation k the rows are ordered by hash, and the classes take consecutive runs of that order, each as long as the class is
    large. That is a uniform shuffle of the labels, and it is decided by the hashes at the run ends alone. The ranks of all run ends
    are looked for at once: running class sizes meet the running counts of hash prefixes, and only prefixes that hold
    an end are sorted. A row finds its run by a prefix of its own hash, among the few ends that share it.
    """
    sizes = cut_lineage(df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")))
    facts = sizes.agg(F.count(F.lit(1)).alias("classes"), F.sum("_n").alias("rows")).first()
    classes, rows = facts["classes"], facts["rows"] or 0
    coarse = 1                              # digits after which some 16 ends share a prefix,
    while classes > 16 * 16**coarse:
        coarse += 1
    fine = max(coarse, HASH_DIGITS)         # and after which a prefix has few enough rows to sort
    while rows > ROWS_PER_BUCKET * 16**fine:
        fine += 1
    every = F.explode(F.sequence(F.lit(1), F.lit(perms))).alias("k")
    ends = running_totals(sizes, [], "_label", "_n", "_hi").select("_label", "_hi", every)

    hashed = df.select(id_col, every).select("k", hash_text(seed, id_col, "k").alias("_h")).withColumn("_p", F.substring("_h", 1, fine))
    counts = running_totals(hashed.groupBy("k", "_p").agg(F.count(F.lit(1)).alias("_n")), ["k"], "_p", "_n", "_upto")
    # ranks are cut into stretches as long as a prefix is on average, so an end meets only the prefixes of its own stretch
    stretch = max(1, -(-rows // 16**fine))
    spans = counts.withColumn("_s", F.explode(F.sequence(F.expr(f"(_upto - _n) div {stretch}"), F.expr(f"(_upto - 1) div {stretch}"))))
    wanted = ends.withColumn("_s", F.expr(f"(_hi - 1) div {stretch}")).join(spans, ["k", "_s"]).where(
        (F.col("_hi") > F.col("_upto") - F.col("_n")) & (F.col("_hi") <= F.col("_upto"))).select(
        "k", "_p", "_label", (F.col("_hi") - F.col("_upto") + F.col("_n")).alias("_rank"))
    wanted = cut_lineage(wanted)
    spots = wanted.select("k", "_p").distinct()
    few = classes * perms * 64 <= SMALL_BYTES             # bytes that the ends, or the lookup below, can take
    local = hashed.join(F.broadcast(spots) if few else spots, ["k", "_p"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy("k", "_p").orderBy("_h")).cast("bigint"))
    cuts = local.join(F.broadcast(wanted) if few else wanted, ["k", "_p", "_rank"]).select(
        "k", F.substring("_h", 1, coarse).alias("_p"), F.struct("_h", "_label").alias("_cut"))
    cuts = cuts.groupBy("k", "_p").agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    # past the last end of a prefix comes the run that ends first in a later one
    grid = counts.select("k", F.substring("_p", 1, coarse).alias("_p")).distinct().join(cuts, ["k", "_p"], "left")
    later = W.partitionBy("k").orderBy("_p").rowsBetween(1, W.unboundedFollowing)
    lookup = cut_lineage(grid.select("k", "_p", "_cuts", F.first(F.get("_cuts", F.lit(0)), ignorenulls=True).over(later)["_label"].alias("_after")))

    small = few and perms * 16**coarse * 64 <= SMALL_BYTES
    out = df.select("*", every).withColumn("_h", hash_text(seed, id_col, "k")).withColumn("_p", F.substring("_h", 1, coarse))
    out = out.join(F.broadcast(lookup) if small else lookup, ["k", "_p"])
    ahead = F.filter("_cuts", lambda c: c["_h"] >= F.col("_h"))
    found = F.when(F.size(ahead) > 0, F.get(ahead, F.lit(0))["_label"]).otherwise(F.col("_after"))
    keep = [c for c in df.columns if c != label]
    return out.select(*keep, "k", found.alias(label))


def _permuted_numeric(df: DataFrame, shuffled: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                      perms: int, k: int = NEIGHBORS) -> DataFrame:
    """(k, feature, mi) of numbers under all label shuffles at once: a row keeps its numbers and takes a list of class codes."""
    labels = shuffled.select(F.col(id_col).alias("_id"), "k", F.col(label).cast("string").alias("y"))
    sizes = labels.where("y is not null").groupBy("k", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    codes = running_totals(sizes.withColumn("_one", F.lit(1)), ["k"], "y", "_one", "_code").select("k", "y", "_code")
    # A repeated id gets the same labels in all of its rows. A class of one row is left out.
    coded = F.struct("k", F.coalesce(F.col("_code"), F.lit(-1)).cast("int").alias("c"))
    lists = labels.join(codes, ["k", "y"], "left").groupBy("_id").agg(
        F.array_sort(F.collect_set(coded)).alias("_l"), F.count(F.lit(1)).alias("_n"))
    names = [f"_x{i}" for i in range(len(numeric))]
    wide = df.select(F.col(id_col).alias("id"), *[to_number(c).alias(n) for n, c in zip(names, numeric)])
    wide = cut_lineage(wide.join(lists, F.col("id").eqNullSafe(F.col("_id"))).select(
        "id", *names, F.transform("_l", lambda s: s["c"]).alias("ys"),
        F.when(F.col("_n") > perms, F.xxhash64("id")).otherwise(0).alias("u")))
    points = _jittered(wide.select("id", "ys", "u", _stacked(names, numeric)).where("x is not null"), [])
    unnamed = None
    if not df.where(F.col(label).isNull()).isEmpty():
        each = F.explode(F.array(*[F.lit(c) for c in numeric])).alias("feature")
        unnamed = labels.where("y is null").groupBy(F.col("k").alias("_k")).agg(F.count(F.lit(1)).alias("ny")).where("ny > 1")
        unnamed = unnamed.select(each, "_k", "ny")
    mi = _estimate(points, ["feature"], Splits(points, ["feature"], "x"), perms, k, unnamed)
    return mi.select(F.col("_k").alias("k"), "feature", "mi")


def permutation_mi(df: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                   categorical: Sequence[str], perms: int, seed: int = 0,
                   estimator: str = "knn") -> DataFrame:
    """(k, feature, mi) under ``perms`` label shuffles. Missing numbers are already filled in."""
    shuffled = permuted_labels(df.select(id_col, label, *numeric, *categorical), id_col, label,
                               perms, seed)
    parts = []
    if categorical:
        parts.append(mi_discrete(category_counts(shuffled, label, categorical, ["k"]), ["k"]))
    if numeric:
        if estimator == "knn":
            parts.append(_permuted_numeric(df, shuffled, id_col, label, numeric, perms))
        else:
            cells = numeric_cells(shuffled, id_col, label, numeric, ["k"])
            edges = cut_lineage(bin_edges(numeric_cells(df, id_col, label, numeric)))
            parts.append(mi_discrete(binned_counts(cells, ["k"], edges=edges), ["k"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def null_p95(mi: DataFrame) -> DataFrame:
    """(feature, null_p95): 95th percentile over the shuffles, a handful of values per feature."""
    return mi.groupBy("feature").agg(F.percentile("mi", 0.95).alias("null_p95"))
