"""Screening queries: information, ranks, stability, verdicts, and the baseline model."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigscreen.operators import baseline as B
from sigscreen.operators import boosting as X
from sigscreen.operators import information as I
from sigscreen.operators import ranks as R
from sigscreen.operators.counts import coverage, label_entropy
from sigscreen.operators.folds import stratified_folds
from sigscreen.operators.stability import slice_mi, stability_cv, time_slices
from sigscreen.operators.verdict import class_quartiles, verdicts
from sigscreen.plans.screen import rescreen_diff, screen
from sigscreen.runtime import cut_lineage
from sigscreen.workload import data as D
from sigscreen.workload.cleaning import SOURCE_PREDICTIONS, source_predictions
from sigscreen.workload.registry import (
    Tables, knn_mi_ctes, md5_of, mi_sql, query, r6, unpivot_sql)

PERMS = 30
CATS = ["n_name", "c_mktsegment"]
ENTROPY = ("ent AS (SELECT ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double AS h FROM "
           "(SELECT r_name, count(*) AS n FROM nf GROUP BY 1))")
CAT_COUNTS = ("cc AS (SELECT feature, x, y, count(*) AS n FROM ("
              + unpivot_sql("nf", CATS, "r_name AS y", "varchar") + ") GROUP BY 1, 2, 3)")


@query("mi_discrete", f"WITH {D.NATION_FEATURES}, {CAT_COUNTS}, mi AS ({mi_sql('cc')}) "
       f"SELECT feature, {r6('mi', 'mi')} FROM mi")
def mi_discrete(t: Tables):
    return I.mi_discrete(I.category_counts(D.nation_features(t), "r_name", CATS))


@query("mi_ratio", f"WITH {D.NATION_FEATURES}, {CAT_COUNTS}, mi AS ({mi_sql('cc')}), {ENTROPY} "
       f"SELECT feature, {r6('mi', 'mi')}, {r6('mi / h', 'mi_ratio')} FROM mi, ent")
def mi_ratio(t: Tables):
    rows = D.nation_features(t)
    mi = I.mi_discrete(I.category_counts(rows, "r_name", CATS))
    h = label_entropy(rows, "r_name").select("entropy", F.lit(0).alias("_one"))
    return mi.withColumn("_one", F.lit(0)).join(F.broadcast(h), "_one").select(
        "feature", "mi", (F.col("mi") / F.col("entropy")).alias("mi_ratio"))


DOC_CELLS = "cells AS (SELECT 'n_chars' AS feature, doc_id AS id, lang AS y, n_chars::double AS x FROM documents)"
MONEY_CELLS = ("cells AS (" + unpivot_sql("nums", ["balance", "spend", "mean_price"],
                                          "id, segment AS y", "double") + ")")


@query("mi_numeric", f"WITH {DOC_CELLS}, {knn_mi_ctes('cells')} SELECT feature, {r6('mi', 'mi')} "
       "FROM knn")
def mi_numeric(t: Tables):
    return I.mi_numeric(I.numeric_cells(t.documents, "doc_id", "lang", ["n_chars"]))


@query("mi_numeric_imputed", f"""WITH {D.CUSTOMER_NUMBERS}, raw AS ({unpivot_sql(
    'nums', D.NUMERIC, 'id, segment AS y', 'double')}),
  cells AS (SELECT feature, id, y, coalesce(x, median(x) OVER (PARTITION BY feature)) AS x FROM raw),
  {knn_mi_ctes('cells')} SELECT feature, {r6('mi', 'mi')} FROM knn""")
def mi_numeric_imputed(t: Tables):
    cells = I.numeric_cells(D.customer_numbers(t), "id", "segment", D.NUMERIC)
    return I.mi_numeric(I.impute_median(cells))


# The bin edges come from a sketch, so SQL cannot reproduce them; rows only.
@query("mi_binned")
def mi_binned(t: Tables):
    cells = I.numeric_cells(t.documents, "doc_id", "lang", ["n_chars"])
    return I.mi_discrete(I.binned_counts(cells))


def permuted_sql(source: str, label: str, perms: int) -> str:
    """(id, k, y): labels dealt in runs along the hash order of each permutation."""
    return f"""ks AS (SELECT k FROM generate_series(1, {perms}) s(k)),
    ends AS (SELECT {label} AS y, sum(count(*)) OVER (ORDER BY {label}) AS hi,
      count(*) AS n FROM {source} GROUP BY 1),
    placed AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY {md5_of('id', 'k')}) AS pos
      FROM {source}, ks),
    perm AS (SELECT id, k, y FROM placed JOIN ends ON pos > hi - n AND pos <= hi)"""


PERM_COUNTS = ("pc AS (SELECT k, feature, x, y, count(*) AS n FROM (SELECT k, feature, x, perm.y "
               "FROM (" + unpivot_sql("nf", CATS, "id", "varchar")
               + ") c JOIN perm USING (id)) GROUP BY 1, 2, 3, 4)")
NULLS = (f"nulls AS (SELECT feature, quantile_cont(mi, 0.95) AS null_p95 FROM "
         f"({mi_sql('pc', 'k, feature')}) GROUP BY 1)")


@query("permuted_labels", f"WITH {D.NATION_FEATURES}, {permuted_sql('nf', 'r_name', PERMS)} "
       "SELECT id, k, y AS r_name FROM perm")
def permuted(t: Tables):
    return I.permuted_labels(D.nation_features(t).select("id", "r_name"), "id", "r_name", PERMS)


@query("permutation_null", f"WITH {D.NATION_FEATURES}, {permuted_sql('nf', 'r_name', PERMS)}, "
       f"{PERM_COUNTS}, {NULLS} SELECT feature, {r6('null_p95', 'null_p95')} FROM nulls")
def permutation_null(t: Tables):
    return I.null_p95(I.permutation_mi(D.nation_features(t), "id", "r_name", [], CATS, PERMS))


@query("permutation_null_numeric", f"""WITH {permuted_sql(
    "(SELECT doc_id AS id, lang FROM documents)", 'lang', PERMS)},
  cells AS (SELECT k, 'n_chars' AS feature, id, y, n_chars::double AS x FROM perm
    JOIN documents ON id = doc_id), {knn_mi_ctes('cells', 'k, feature')}
  SELECT feature, {r6('quantile_cont(mi, 0.95)', 'null_p95')} FROM knn GROUP BY 1""")
def permutation_null_numeric(t: Tables):
    rows = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return I.null_p95(I.permutation_mi(rows, "doc_id", "lang", ["n_chars"], [], PERMS))


@query("null_p95", f"WITH {D.NATION_FEATURES}, {permuted_sql('nf', 'r_name', PERMS)}, "
       f"{PERM_COUNTS}, {NULLS}, {CAT_COUNTS}, mi AS ({mi_sql('cc')}) SELECT feature, "
       "mi > null_p95 AS beats_null FROM mi JOIN nulls USING (feature)")
def beats_null(t: Tables):
    rows = D.nation_features(t)
    mi = I.mi_discrete(I.category_counts(rows, "r_name", CATS))
    null = I.null_p95(I.permutation_mi(rows, "id", "r_name", [], CATS, PERMS))
    return mi.join(null, "feature").select("feature", (F.col("mi") > F.col("null_p95")).alias(
        "beats_null"))


# ---- ranks --------------------------------------------------------------------------------

ITEM_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
ITEM_CELLS = "cells AS (" + unpivot_sql("lineitem", ITEM_COLS, "l_returnflag AS y", "double") + ")"
RANKED = """ranked AS (SELECT feature, y, x, rank() OVER (PARTITION BY feature ORDER BY x)
    + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::double AS r,
    count(*) OVER (PARTITION BY feature, x) AS ties FROM cells WHERE x IS NOT NULL),
  per AS (SELECT feature, y, sum(r) AS s, count(*)::double AS n FROM ranked GROUP BY 1, 2),
  tot AS (SELECT feature, sum(n) AS n FROM per GROUP BY 1)"""
AUCS = """aucs AS (SELECT feature, y, (s - p.n * (p.n + 1) / 2) / (p.n * (tot.n - p.n)) AS auc,
    tot.n AS n FROM per p JOIN tot USING (feature) WHERE tot.n > p.n)"""


def item_cells(t: Tables):
    rows = t.lineitem.withColumn("id", F.lit(0))
    return I.numeric_cells(rows, "id", "l_returnflag", ITEM_COLS)


@query("best_ovr_auc", f"WITH {ITEM_CELLS}, {RANKED}, {AUCS} SELECT feature, "
       f"{r6('greatest(0.5, max(greatest(auc, 1 - auc)))', 'best_auc')} FROM aucs GROUP BY 1")
def best_ovr_auc(t: Tables):
    return R.best_ovr_auc(item_cells(t))


@query("class_auc", f"WITH {ITEM_CELLS}, {RANKED}, {AUCS} SELECT feature, y, {r6('auc', 'auc')} "
       "FROM aucs")
def class_auc(t: Tables):
    return R.class_auc(item_cells(t)).select("feature", "y", "auc")


@query("kruskal_h", f"""WITH {ITEM_CELLS}, {RANKED}, t AS (SELECT feature,
    sum(ties::double * ties - 1) AS t FROM ranked GROUP BY 1)
  SELECT feature, {r6('(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n))', 'h')}
  FROM (SELECT feature, sum(s * s / n) AS q FROM per GROUP BY 1) JOIN tot USING (feature)
  JOIN t USING (feature)""")
def kruskal_h(t: Tables):
    return R.kruskal_h(item_cells(t))


BANDED = ["spend_band", *D.NUMERIC]        # with a column that repeats another one in steps


def spearman_sql(cols: list[str]) -> str:
    return f"""WITH {D.CUSTOMER_NUMBERS}, banded AS (SELECT *, floor(spend / 1000)::double AS spend_band FROM nums),
  c AS ({unpivot_sql('banded', cols, 'id', 'double')}),
  p AS (SELECT a.feature AS a, b.feature AS b, a.x AS xa, b.x AS xb FROM c a JOIN c b USING (id)
    WHERE a.feature <> b.feature AND a.x IS NOT NULL AND b.x IS NOT NULL),
  r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa)
      + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0::double AS ra,
    rank() OVER (PARTITION BY a, b ORDER BY xb)
      + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0::double AS rb FROM p),
  s AS (SELECT a, b, corr(ra, rb) AS rho FROM r GROUP BY 1, 2)"""


@query("spearman_pairs", f"{spearman_sql(D.NUMERIC)} SELECT a, b, {r6('rho', 'rho')} FROM s")
def spearman_pairs(t: Tables):
    return R.spearman_pairs(D.customer_numbers(t), "id", D.NUMERIC)


@query("spearman_redundancy", f"""{spearman_sql(BANDED)} SELECT feature, redundant_with, {r6('rho', 'rho')}
  FROM (SELECT a AS feature, b AS redundant_with, abs(rho) AS rho, row_number() OVER
    (PARTITION BY a ORDER BY round(abs(rho), 12) DESC, b) AS rk FROM s) WHERE rk = 1 AND rho > 0.9""")
def spearman_redundancy(t: Tables):
    rows = D.customer_numbers(t).withColumn("spend_band", F.floor(F.col("spend") / 1000).cast("double"))
    return R.spearman_redundancy(R.spearman_pairs(rows, "id", BANDED))


# ---- time ------------------------------------------------------------------------------------

def slices_sql(source: str, key: str, ts: str, cols: str) -> str:
    return (f"SELECT {cols}, greatest(0, ceil((pos - 1) * 4::double / (n - 1)) - 1)::bigint AS slice "
            f"FROM (SELECT *, row_number() OVER (ORDER BY {ts}, {md5_of(key)}, {key}) AS pos, "
            f"count(*) OVER () AS n FROM {source} WHERE {ts} IS NOT NULL)")


@query("time_slices", slices_sql("events", "event_id", "ts", "event_id"))
def slices(t: Tables):
    return time_slices(t.events.select("event_id", "ts"), "event_id", "ts").drop("ts")


@query("stability_cv", f"""WITH cut AS ({slices_sql('orders', 'o_orderkey', 'o_orderdate',
    'o_orderkey AS id, o_orderstatus AS y, o_orderpriority, o_totalprice')}),
  sc AS (SELECT slice, 'o_orderpriority' AS feature, o_orderpriority AS x, y, count(*) AS n FROM cut
    GROUP BY ALL),
  cells AS (SELECT slice, 'o_totalprice' AS feature, id, y, o_totalprice AS x FROM cut),
  {knn_mi_ctes('cells', 'slice, feature')},
  mi AS ({mi_sql('sc', 'slice, feature')} UNION ALL SELECT slice, feature, mi FROM knn)
  SELECT feature, {r6('abs(stddev_samp(mi) / (avg(mi) + 1e-9::double))', 'stability_cv')}
  FROM mi GROUP BY 1""")
def stability(t: Tables):
    mi = slice_mi(t.orders, "o_orderkey", "o_orderstatus", "o_orderdate", ["o_totalprice"],
                  ["o_orderpriority"])
    return stability_cv(mi)


@query("class_quartiles", f"""WITH {ITEM_CELLS} SELECT feature, y,
  {r6('quantile_cont(x, 0.25)', 'q25')}, {r6('quantile_cont(x, 0.5)', 'q50')},
  {r6('quantile_cont(x, 0.75)', 'q75')} FROM cells GROUP BY 1, 2""")
def quartiles(t: Tables):
    return class_quartiles(item_cells(t))


# ---- verdicts and model ---------------------------------------------------------------------------

@query("verdicts", f"""WITH {D.NATION_FEATURES}, {permuted_sql('nf', 'r_name', PERMS)},
  {PERM_COUNTS}, {NULLS}, {CAT_COUNTS}, mi AS ({mi_sql('cc')}), {ENTROPY},
  s AS (SELECT feature, mi, mi / h AS ratio, null_p95 FROM mi JOIN nulls USING (feature), ent)
  SELECT feature, CASE WHEN mi <= null_p95 THEN 'drop' WHEN ratio > 0.8 THEN 'investigate'
    WHEN mi < null_p95 * 1.5 THEN 'investigate' ELSE 'keep' END AS recommend,
  CASE WHEN mi <= null_p95 THEN 'no signal over null' WHEN ratio > 0.8
    THEN 'explains most of the label — check leakage' WHEN mi < null_p95 * 1.5
    THEN 'weak incremental value' ELSE 'beats null, contributes in model' END AS reason,
  {r6('mi', 'mi')}, {r6('ratio', 'mi_ratio')}, {r6('null_p95', 'null_p95')},
  mi > null_p95 AS beats_null, 1.0::double AS coverage FROM s""")
def verdict_table(t: Tables):
    rows = D.nation_features(t)
    stats = mi_ratio(t).join(I.null_p95(I.permutation_mi(
        rows, "id", "r_name", [], CATS, PERMS)), "feature").join(coverage(rows, CATS), "feature")
    missing = [F.lit(None).cast("double").alias(c) for c in ("best_auc", "importance", "stability_cv")]
    table = verdicts(stats.select("*", *missing, F.lit(None).cast("string").alias("redundant_with")))
    return table.select("feature", "recommend", "reason", "mi", "mi_ratio", "null_p95",
                        "beats_null", "coverage")


@query("macro_f1", f"""WITH {SOURCE_PREDICTIONS}, cls AS (SELECT lang AS c FROM preds UNION
    SELECT predicted FROM preds)
  SELECT {r6('avg(f)', 'macro_f1')} FROM (SELECT 2.0::double * count(*) FILTER (lang = c AND
    predicted = c) / (count(*) FILTER (lang = c) + count(*) FILTER (predicted = c)) AS f
    FROM preds, cls GROUP BY c)""")
def macro_f1(t: Tables):
    n = source_predictions(t).groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return B.macro_f1(n, "lang", "predicted")


LANGS = ["de", "en", "es", "fr"]


@query("macro_auc", """WITH share AS (SELECT a.source, b.lang AS c, (SELECT count(*) FROM documents d
    WHERE d.source = a.source AND d.lang = b.lang)::double / count(*) OVER (PARTITION BY a.source)
    AS s FROM (SELECT DISTINCT source FROM documents) a, (SELECT DISTINCT lang FROM documents) b),
  n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
  cells AS (SELECT c AS feature, (lang = c)::varchar AS y, s * 4 / n.n AS x FROM documents
    JOIN share USING (source) JOIN n USING (source)),
  """ + RANKED + ", " + AUCS + f""" SELECT {r6('avg(auc)', 'macro_auc')} FROM aucs
  WHERE y = 'true'""")
def macro_auc(t: Tables):
    shares = t.documents.groupBy("source").agg(F.array(*[
        F.avg((F.col("lang") == c).cast("double")) for c in LANGS]).alias("scores"))
    label = F.array_position(F.array(*[F.lit(c) for c in LANGS]), F.col("lang")) - 1
    rows = t.documents.select("source", label.cast("double").alias("y")).join(shares, "source")
    return B.macro_auc(rows)


def model_rows(t: Tables):
    """Customers as vectors with folds; the label is the region."""
    rows = I.encode_features(D.nation_features(t), "id", ["c_acctbal"], CATS, ["r_name"])
    dealt = stratified_folds(rows, "id", "r_name").drop("r_name")
    return cut_lineage(B.assemble(
        rows.join(dealt, "id"), "r_name", ["c_acctbal"], CATS, ["id", "fold"])[0])


@query("out_of_fold")
def out_of_fold(t: Tables):
    return B.out_of_fold(model_rows(t)).select("id", "y", "prediction")


@query("permutation_importance")
def permutation_importance(t: Tables):
    return B.permutation_importance(model_rows(t), ["c_acctbal", *CATS])


# ---- boosted trees ------------------------------------------------------------------------------

BOOSTED = X.Settings(rounds=2, depth=2, bins=16)


def boosted_sql(s: X.Settings) -> str:
    """The fit of one model on nation_features, round by round and level by level; ends in (id, class, score)."""
    ctes = [D.NATION_FEATURES, "cls AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS t, count(*) AS n FROM nf GROUP BY 1)",
            f"""cut AS (SELECT list_distinct(quantile_cont(c_acctbal, [{', '.join(f'{i / s.bins}::double' for i in range(1, s.bins))}])) AS edges
              FROM nf)""",
            f"""levels AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY {md5_of('x')}) AS bin FROM (
              {' UNION '.join(f"SELECT {i} AS feature, {c} AS x FROM nf" for i, c in enumerate(CATS, 1))}))""",
            """cells AS MATERIALIZED (SELECT id, 0 AS feature, len(list_filter(edges, lambda e: e < c_acctbal)) AS bin FROM nf, cut
              UNION ALL """ + " UNION ALL ".join(
                f"SELECT id, {i}, bin FROM nf JOIN levels ON feature = {i} AND x = {c}" for i, c in enumerate(CATS, 1)) + ")",
            """s0 AS (SELECT id, t, ln((n + 1)::double / ((SELECT count(*) FROM nf) + (SELECT count(*) FROM cls))) AS s,
              (nf.r_name = cls.r_name)::int AS hit FROM nf, cls)"""]
    for r in range(s.rounds):
        ctes.append(f"""g{r} AS MATERIALIZED (SELECT id, t, s, hit, p - hit AS g, p * (1 - p) AS h FROM (
            SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM s{r}))""")
        ctes.append(f"at{r}_0 AS (SELECT id, t, 1 AS node FROM g{r})")
        for d in range(s.depth):
            ctes += [
                f"""st{r}_{d} AS MATERIALIZED (SELECT *, CASE WHEN feature = 0 THEN bin ELSE round(g / (h + {s.smooth}), {X.DIGITS}) END AS place
                  FROM (SELECT t, node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM at{r}_{d} JOIN g{r} USING (id, t)
                    JOIN cells USING (id) GROUP BY ALL))""",
                f"""best{r}_{d} AS MATERIALIZED (SELECT t, node, feature, place, bin FROM (
                  SELECT *, round(lg * lg / (lh + {s.l2}) + (ag - lg) * (ag - lg) / (ah - lh + {s.l2}) - ag * ag / (ah + {s.l2}), {X.DIGITS}) AS gain
                  FROM (SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER a AS ag, sum(h) OVER a AS ah,
                      sum(n) OVER a AS an FROM st{r}_{d} WINDOW w AS (PARTITION BY t, node, feature ORDER BY place, bin),
                      a AS (PARTITION BY t, node, feature)))
                  WHERE gain > 0 AND ln >= {s.min_rows} AND an - ln >= {s.min_rows}
                  QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY gain DESC, feature, place, bin) = 1)""",
                f"""at{r}_{d + 1} AS MATERIALIZED (SELECT a.id, a.t, 2 * a.node + coalesce((st.place, st.bin) > (b.place, b.bin), false)::int AS node
                  FROM at{r}_{d} a LEFT JOIN best{r}_{d} b USING (t, node) LEFT JOIN cells c ON c.id = a.id AND c.feature = b.feature
                  LEFT JOIN st{r}_{d} st ON st.t = a.t AND st.node = a.node AND st.feature = b.feature AND st.bin = c.bin)"""]
        ctes.append(f"""s{r + 1} AS (SELECT id, t, s - {s.rate} * sum(g) OVER w / (sum(h) OVER w + {s.l2}) AS s, hit
            FROM g{r} JOIN at{r}_{s.depth} USING (id, t) WINDOW w AS (PARTITION BY t, node))""")
    return (f"WITH {', '.join(ctes)} SELECT id, r_name AS class, {r6('exp(s) / sum(exp(s)) OVER (PARTITION BY id)', 'score')} "
            f"FROM s{s.rounds} JOIN cls USING (t)")


@query("boosted_fit", boosted_sql(BOOSTED))
def boosted_fit(t: Tables):
    """Two rounds of trees of depth 2, and each customer's probability of each region by them."""
    rows = I.encode_features(D.nation_features(t), "id", ["c_acctbal"], CATS, ["r_name"])
    data, classes = B.assemble(rows, "r_name", ["c_acctbal"], CATS, ["id"])
    trees, scored = X.fit(cut_lineage(data), 1, None, BOOSTED)
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select("id", F.posexplode(X.probabilities("scores", trees.classes)).alias("t", "score")).select(
        "id", F.get(names, F.col("t")).alias("class"), "score")


def _screen(t: Tables, exclude=()):
    rows = D.customer_numbers(t).join(D.nation_features(t).select("id", "n_name"), "id").join(
        t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("since")),
        "id", "left")
    labels = D.nation_features(t).select("id", "r_name")
    return screen(rows, labels, "id", "r_name", time_col="since", n_perm=PERMS, exclude=exclude)


@query("screen")
def screened(t: Tables):
    return _screen(t).verdicts


@query("screen_summary")
def summary(t: Tables):
    return _screen(t).summary


@query("rescreen")
def rescreened(t: Tables):
    """The loop closed: screen, cut the flagged features, screen again, compare."""
    first = _screen(t).verdicts
    cut = [r["feature"] for r in first.where("recommend = 'investigate'").collect()]
    return rescreen_diff(first, _screen(t, cut).verdicts)


# ---- the whole screen, checked ---------------------------------------------------------------------

# One planted feature for each outcome: (name, SQL over customer, nation and the date of the first order; numbers first).
NUMBERS = {
    "region_number": "n_regionkey * 1000 + c_custkey % 100",                                            # an AUC near 1
    "seldom": "CASE WHEN c_custkey % 8 = 0 THEN n_regionkey * 1000 + c_custkey % 101 END",              # mostly missing
    "hint": "n_regionkey * 10 + c_custkey % 61",                                                        # two that say the same
    "hint_again": "2 * (n_regionkey * 10 + c_custkey % 61) + c_custkey % 2",
    "fades": "CASE WHEN since < '1995-03-01' THEN n_regionkey * 120 ELSE 0 END + (c_custkey * 7919) % 613",   # early customers only
}
KINDS = {
    "nation": "n_name",                                                                                 # settles the label
    "segment": "c_mktsegment",                                                                          # noise
    "some_nation": "CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE 'other' END",                          # honest signal
    "faint": "CASE WHEN c_custkey % 100 = 0 THEN r_name ELSE c_mktsegment END",                          # hardly any
}


def planted(t: Tables):
    """(id, r_name, since, features) of all customers."""
    since = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("since"))
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).join(since, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("id"), "r_name", "since", *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in NUMBERS.items()],
                       *[F.expr(e).alias(c) for c, e in KINDS.items()])


def screen_sql() -> str:
    """All statistics of the planted features, and the verdicts by the rules; ends in ``judged``."""
    nums, cats = list(NUMBERS), list(KINDS)
    return f"""WITH b AS MATERIALIZED (SELECT c_custkey AS id, r_name, since, {', '.join(f'({e})::double AS {c}' for c, e in NUMBERS.items())},
      {', '.join(f'{e} AS {c}' for c, e in KINDS.items())} FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS since FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
    ent AS (SELECT ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double AS h FROM (SELECT count(*) AS n FROM b GROUP BY r_name)),
    rawc AS MATERIALIZED ({unpivot_sql('b', nums, 'id, r_name AS y, since', 'double')}),
    fillc AS MATERIALIZED (SELECT feature, id, y, coalesce(x, median(x) OVER (PARTITION BY feature)) AS x FROM rawc),
    kinds AS MATERIALIZED ({unpivot_sql('b', cats, 'id, r_name AS y', 'varchar')}),
    kc AS (SELECT feature, x, y, count(*) AS n FROM kinds GROUP BY ALL),
    mis AS MATERIALIZED ((WITH {knn_mi_ctes('fillc')} SELECT feature, mi FROM knn) UNION ALL ({mi_sql('kc')})),
    {permuted_sql('b', 'r_name', PERMS)},
    pcells AS MATERIALIZED (SELECT k, feature, id, perm.y, x FROM fillc JOIN perm USING (id)),
    pkinds AS (SELECT k, feature, x, perm.y, count(*) AS n FROM kinds JOIN perm USING (id) GROUP BY ALL),
    nulls AS MATERIALIZED (SELECT feature, quantile_cont(mi, 0.95) AS null_p95 FROM ((WITH {knn_mi_ctes('pcells', 'k, feature')} SELECT k, feature, mi FROM knn)
      UNION ALL ({mi_sql('pkinds', 'k, feature')})) GROUP BY 1),
    best AS MATERIALIZED (WITH cells AS (SELECT * FROM rawc), {RANKED}, {AUCS} SELECT feature,
      CASE WHEN max(n) >= 20 THEN greatest(0.5, max(greatest(auc, 1 - auc))) END AS best_auc FROM aucs GROUP BY 1),
    rhos AS MATERIALIZED (WITH p AS (SELECT a.feature AS a, b.feature AS b, a.x AS xa, b.x AS xb FROM rawc a JOIN rawc b USING (id)
        WHERE a.feature <> b.feature AND a.x IS NOT NULL AND b.x IS NOT NULL),
      r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0::double AS ra,
        rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0::double AS rb FROM p)
      SELECT a AS feature, b AS redundant_with, abs(rho) AS rho, row_number() OVER (PARTITION BY a ORDER BY round(abs(rho), 12) DESC, b) AS rk
      FROM (SELECT a, b, corr(ra, rb) AS rho FROM r GROUP BY 1, 2)),
    cut AS MATERIALIZED ({slices_sql('b', 'id', 'since', 'id, r_name AS y')}),
    good AS (SELECT slice FROM cut GROUP BY 1 HAVING count(*) >= 50 AND count(DISTINCT y) > 1),
    scells AS MATERIALIZED (SELECT slice, feature, id, cut.y, coalesce(x, median(x) OVER (PARTITION BY slice, feature), 0) AS x FROM rawc
      JOIN cut USING (id) JOIN good USING (slice)),
    skinds AS (SELECT slice, feature, x, cut.y, count(*) AS n FROM kinds JOIN cut USING (id) JOIN good USING (slice) GROUP BY ALL),
    cvs AS MATERIALIZED (SELECT feature, abs(stddev_samp(mi) / (avg(mi) + 1e-9::double)) AS cv
      FROM ((WITH {knn_mi_ctes('scells', 'slice, feature')} SELECT slice, feature, mi FROM knn) UNION ALL ({mi_sql('skinds', 'slice, feature')}))
      GROUP BY 1 HAVING count(*) > 1),
    there AS (SELECT feature, avg((x IS NOT NULL)::int) AS coverage FROM (SELECT feature, x::varchar AS x FROM rawc UNION ALL SELECT feature, x FROM kinds) GROUP BY 1),
    facts AS (SELECT feature, mi, mi / h AS ratio, null_p95, best_auc, coverage, cv, CASE WHEN rho > 0.9 THEN redundant_with END AS twin
      FROM mis JOIN nulls USING (feature) JOIN there USING (feature) LEFT JOIN best USING (feature) LEFT JOIN cvs USING (feature)
      LEFT JOIN (SELECT * FROM rhos WHERE rk = 1) USING (feature), ent),
    judged AS (SELECT *, {recommend_sql()} AS recommend FROM (SELECT *, {reason_sql('twin')} AS reason FROM facts))"""


def reason_sql(twin: str) -> str:
    """The first rule that applies, where no model is asked."""
    return f"""CASE WHEN mi <= null_p95 THEN 'no signal over null' WHEN coverage < 0.2 THEN 'too sparse'
      WHEN best_auc > 0.97 THEN 'suspiciously strong — check leakage' WHEN ratio > 0.8 THEN 'explains most of the label — check leakage'
      WHEN {twin} IS NOT NULL THEN 'redundant with ' || {twin} WHEN cv > 1 THEN 'unstable over time'
      WHEN mi < null_p95 * 1.5 THEN 'weak incremental value' ELSE 'beats null, contributes in model' END"""


def recommend_sql() -> str:
    return """CASE WHEN reason IN ('no signal over null', 'too sparse') THEN 'drop' WHEN reason LIKE 'beats%' THEN 'keep'
      ELSE 'investigate' END"""


def screened_planted(t: Tables, exclude=()):
    rows = planted(t)
    return screen(rows.drop("r_name"), rows.select("id", "r_name"), "id", "r_name", time_col="since", n_perm=PERMS, exclude=exclude,
                  model=None, charts=False)


@query("screen_verdicts", f"""{screen_sql()} SELECT feature, recommend, reason, {r6('mi', 'mi')}, {r6('ratio', 'mi_ratio')},
  {r6('null_p95', 'null_p95')}, mi > null_p95 AS beats_null, {r6('best_auc', 'best_auc')}, 0.0::double AS importance,
  {r6('coverage', 'coverage')}, {r6('cv', 'stability_cv')} FROM judged""")
def screen_verdicts(t: Tables):
    """The screen without a model over features planted for each of its eight outcomes."""
    return screened_planted(t).verdicts


@query("screen_counts", f"""{screen_sql()} SELECT (SELECT count(*) FROM b) AS sample_rows, (SELECT count(DISTINCT r_name) FROM b) AS classes,
  count(*) AS features, NULL::double AS macro_f1, NULL::double AS macro_auc, count(*) FILTER (recommend = 'keep') AS keep,
  count(*) FILTER (recommend = 'investigate') AS investigate, count(*) FILTER (recommend = 'drop') AS drop FROM judged""")
def screen_counts(t: Tables):
    return screened_planted(t).summary


@query("rescreen_verdicts", f"""{screen_sql()}, flags AS (SELECT feature FROM judged WHERE recommend = 'investigate'),
  left_over AS (SELECT feature, redundant_with AS twin2, row_number() OVER (PARTITION BY feature ORDER BY round(rho, 12) DESC, redundant_with) AS rk2, rho
    FROM rhos WHERE feature NOT IN (FROM flags) AND redundant_with NOT IN (FROM flags)),
  again AS (SELECT feature, mi, {recommend_sql()} AS recommend FROM (SELECT facts.*, {reason_sql('twin2')} AS reason FROM facts
    LEFT JOIN (SELECT feature, twin2 FROM left_over WHERE rk2 = 1 AND rho > 0.9) USING (feature)) WHERE feature NOT IN (FROM flags))
  SELECT j.feature, j.recommend AS before, a.recommend AS after, {r6('j.mi', 'mi_before')}, {r6('a.mi', 'mi_after')}
  FROM judged j LEFT JOIN again a USING (feature)""")
def rescreen_verdicts(t: Tables):
    """The loop closed on the planted features: what was flagged is cut, and the rest is judged again."""
    first = screened_planted(t).verdicts
    cut = [r["feature"] for r in first.where("recommend = 'investigate'").collect()]
    return rescreen_diff(first, screened_planted(t, cut).verdicts)
