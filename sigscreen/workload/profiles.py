"""Profiling queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigscreen.plans import profile as P
from sigscreen.runtime import cut_lineage
from sigscreen.workload.registry import Tables, md5_of, query, r6

# The tables and column types that the profile is checked on; arrays are left to the unit tests.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def _column_sql(table: str, column: str, dtype: str) -> str:
    named = any(p in column for p in P.TIME_NAME_PARTS)
    v = f"{column}::varchar"
    if dtype == "timestamp_ntz":
        is_time = "true"
    elif named and dtype == "string":
        is_time = f"coalesce(bool_and(try_cast({column} AS TIMESTAMP) IS NOT NULL) FILTER ({column} IS NOT NULL), false)"
    else:
        is_time = "false"
    keyable = str(dtype in ("bigint", "int", "string")).lower()
    shown = f"CASE WHEN length({v}) > 24 THEN substr({v}, 1, 21) || '...' ELSE {v} END"
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", '{dtype}' AS dtype,
      count(*) AS row_count, 100.0::double * (count(*) - count({column})) / count(*) AS null_pct,
      count(DISTINCT {column}) AS cardinality,
      (SELECT string_agg(s, ', ' ORDER BY s, k) FROM (SELECT DISTINCT {shown} AS s,
        CASE WHEN length({v}) > 32 THEN '#' || md5({v}) ELSE '=' || {v} END AS k FROM {table}
        WHERE {column} IS NOT NULL ORDER BY s, k LIMIT 3)) AS samples,
      {is_time} AS is_time, {keyable} AS keyable FROM {table}"""


PROFILE = "prof AS (SELECT *, NOT is_time AND null_pct < 5 AND keyable AND row_count > 0 " \
    "AND cardinality::double / row_count > 0.3 AS is_key FROM (" + " UNION ALL ".join(
        _column_sql(t, *col.split()) for t, cols in SCHEMAS.items() for col in cols.split(", ")) + "))"


def profiles(t: Tables, exact_count: bool = False):
    return P.profile(t.spark, {n: getattr(t, n) for n in SCHEMAS}, exact_count=exact_count,
                     approx=False)


@query("profile_columns", f"""WITH {PROFILE} SELECT "table", "column", dtype, row_count,
  {r6('null_pct', 'null_pct')}, cardinality, samples, is_time, is_key FROM prof""")
def profile_columns(t: Tables):
    return profiles(t)["columns"].drop("error")


@query("profile_time_columns", f'WITH {PROFILE} SELECT "table", "column", dtype FROM prof '
       "WHERE is_time")
def profile_time_columns(t: Tables):
    return profiles(t)["columns"].where("is_time").select("table", "column", "dtype")


@query("profile_keys", f'WITH {PROFILE} SELECT "table", "column", row_count, cardinality FROM prof '
       "WHERE is_key")
def profile_keys(t: Tables):
    return profiles(t)["columns"].where("is_key").select(
        "table", "column", "row_count", "cardinality")


@query("join_keys", f"""WITH {PROFILE} SELECT "column" AS key_column,
  string_agg("table", ', ' ORDER BY "table") AS tables FROM prof WHERE is_key GROUP BY 1
  HAVING count(*) > 1""")
def join_keys(t: Tables):
    return profiles(t)["join_keys"].withColumn("tables", F.array_join("tables", ", "))


@query("row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in SCHEMAS))
def row_counts(t: Tables):
    return profiles(t, exact_count=True)["counts"]


# An estimate: SQL cannot give the same number, so only its accuracy is checked in the tests.
@query("approx_keys")
def approx_keys(t: Tables):
    return P.approx_keys(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


KEYS = {
    "customer.c_custkey": ("customer", "c_custkey"), "orders.o_custkey": ("orders", "o_custkey"),
    "events.user_id": ("events", "user_id"), "labels.doc_id": ("labels", "doc_id"),
    "documents.doc_id": ("documents", "doc_id"), "supplier.s_suppkey": ("supplier", "s_suppkey"),
    "lineitem.l_suppkey": ("lineitem", "l_suppkey"),
    "lineitem.l_orderkey": ("lineitem", "l_orderkey"), "orders.o_orderkey": ("orders", "o_orderkey"),
}


@query("key_containment", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS c, {col}::varchar AS v FROM {t}" for n, (t, col) in KEYS.items())
    + f"""), n AS (SELECT c, count(*) AS n FROM v GROUP BY 1),
  s AS (SELECT a.c AS x, b.c AS y, count(*) AS n FROM v a JOIN v b USING (v) GROUP BY 1, 2)
  SELECT f.c AS from_key, g.c AS to_key, f.n AS distinct_from, coalesce(s.n, 0) AS shared,
  {r6('coalesce(s.n, 0)::double / f.n', 'containment')} FROM n f JOIN n g ON f.c <> g.c
  LEFT JOIN s ON s.x = f.c AND s.y = g.c""")
def key_containment(t: Tables):
    return P.key_containment({n: (getattr(t, table), col) for n, (table, col) in KEYS.items()})


SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]


@query("distinct_sketches", "SELECT c AS \"column\", n AS rows, true AS close FROM (VALUES " + ", ".join(
    f"('{c}')" for c in SKETCHED) + ") v(c), (SELECT count(*) AS n FROM lineitem)")
def distinct_sketches(t: Tables):
    """Sketches of the years of lineitem, united, beside the exact counts: each within 5 percent."""
    years = F.year("l_shipdate")
    parts = [P.distinct_sketches(t.lineitem.where(w), SKETCHED, name) for name, w in (
        ("early", years < 1995), ("late", years >= 1995), ("undated", F.col("l_shipdate").isNull()))]
    stored = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    exact = t.lineitem.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).unpivot([], SKETCHED, "column", "exact")
    return P.united_distinct(stored).join(F.broadcast(exact), "column").select(
        "column", "rows", (F.abs(F.col("approx_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


SAMPLED = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query("profile_sample", f"""SELECT {', '.join(SAMPLED)} FROM orders
  ORDER BY {md5_of(*SAMPLED)} LIMIT 1000""")
def profile_sample(t: Tables):
    return P.random_sample(t.orders.select(*SAMPLED), 1000)


CONTAINED = 0.5


@query("key_containment_at_least", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS c, {col}::varchar AS v FROM {t}" for n, (t, col) in KEYS.items())
    + f"""), n AS (SELECT c, count(*) AS n FROM v GROUP BY 1)
  SELECT a.c AS from_key, b.c AS to_key, n.n AS distinct_from, count(*) AS shared, {r6('count(*)::double / n.n', 'containment')}
  FROM v a JOIN v b USING (v) JOIN n ON n.c = a.c WHERE a.c <> b.c GROUP BY 1, 2, 3 HAVING count(*)::double / n.n >= {CONTAINED}""")
def contained_keys(t: Tables):
    """The pairs worth a look, with sketches ahead of the exact counts."""
    return P.key_containment({n: (getattr(t, table), col) for n, (table, col) in KEYS.items()}, CONTAINED)
