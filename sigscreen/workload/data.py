"""How the roles of the engine are played by the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.operators.folds import stratified_folds
from sigscreen.operators.graph import pair_counts
from sigscreen.operators.joins import lookup_join
from sigscreen.runtime import cut_lineage
from sigscreen.workload.registry import Tables, md5_of

# Fixed values shared by both sides.
WORDS = r"(?:^|[ \n])(the|der|die|le|la|el)[ \n.,]"
NUMBERS = r"([0-9]{3})"
BRAND = r"brand[#_ ]?(\d+)"
REFERENCE_TIME = "2002-01-01 00:00:00"


def edges(t: Tables) -> DataFrame:
    """Who contacted whom: the user of an event, and the number in its properties."""
    return t.events.select(
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("bigint").alias("dst"), "event_type", "ts")


def pairs(t: Tables) -> DataFrame:
    return pair_counts(edges(t), "src", "dst")


def kept_pairs(t: Tables) -> DataFrame:
    """``pairs`` written once, for operators that read them several times."""
    return cut_lineage(pairs(t))


def known_segments(t: Tables) -> DataFrame:
    """Every customer; the segment is the label, known for accounts that are not overdrawn."""
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("label"))


def folds(t: Tables) -> DataFrame:
    return stratified_folds(known_segments(t), "id", "label")


def shipments(t: Tables) -> DataFrame:
    """(customer, supplier, part) of every line item."""
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    items = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice")
    return lookup_join(items, owners, "l_orderkey", "inner").drop("l_orderkey")


def supplier_regions(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region_code"))


def messy_parts(t: Tables) -> DataFrame:
    """Parts with an untidy brand (case, spaces) and a flag."""
    return t.part.select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")).alias("brand"),
        (F.col("p_size") > 25).alias("is_large"))


def customer_numbers(t: Tables) -> DataFrame:
    """Numeric facts per customer; activity is missing for customers without events."""
    spend = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).cast("double").alias("orders_n"),
        F.round(F.sum("o_totalprice"), 2).alias("spend"),
        F.round(F.avg("o_totalprice"), 2).alias("mean_price"))
    active = t.events.groupBy(F.col("user_id").alias("id")).agg(
        F.round(F.avg(F.hour("ts").cast("double")), 6).alias("hour_mean"),
        F.round(F.sum("value"), 2).alias("value_sum"))
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                             F.col("c_mktsegment").alias("segment"), "c_nationkey")
    return base.join(spend, "id", "left").join(active, "id", "left")


NUMERIC = ["balance", "orders_n", "spend", "mean_price", "hour_mean", "value_sum"]


def nation_features(t: Tables) -> DataFrame:
    """Customers with a feature that settles the label (nation), one that is noise, and the label."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), "n_name", "c_mktsegment", "c_acctbal", "r_name")


# ---- the same in SQL -----------------------------------------------------------------

FOLDS = f"""known AS (SELECT c_custkey AS id,
    CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS label FROM customer),
  folds AS (SELECT id, label, CASE WHEN label IS NULL THEN -1 ELSE
    (row_number() OVER (PARTITION BY label ORDER BY {md5_of('id')}, id) - 1) % 5 END AS fold
    FROM known)"""

EDGES = """edges AS (SELECT user_id AS src, (json_extract_string(props, '$.k'))::bigint AS dst,
    event_type, ts FROM events)"""

PAIRS = EDGES + """,
  ends AS (SELECT src AS a, dst AS b, 1 AS o, 0 AS i FROM edges
    UNION ALL SELECT dst, src, 0, 1 FROM edges),
  pairs AS MATERIALIZED (SELECT a, b, sum(o)::bigint AS out_n, sum(i)::bigint AS in_n
    FROM ends GROUP BY a, b)"""

SHIPMENTS = """shipments AS (SELECT o_custkey AS id, l_suppkey, l_partkey, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SUPPLIER_REGIONS = """supplier_regions AS (SELECT s_suppkey, r_name AS region_code FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CUSTOMER_NUMBERS = """spends AS (SELECT o_custkey AS id, count(*)::double AS orders_n,
    round(sum(o_totalprice), 2) AS spend, round(avg(o_totalprice), 2) AS mean_price
    FROM orders GROUP BY 1),
  active AS (SELECT user_id AS id, round(avg(hour(ts)::double), 6) AS hour_mean,
    round(sum(value), 2) AS value_sum FROM events GROUP BY 1),
  nums AS (SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey,
    orders_n, spend, mean_price, hour_mean, value_sum
    FROM customer LEFT JOIN spends ON c_custkey = spends.id
    LEFT JOIN active ON c_custkey = active.id)"""

NATION_FEATURES = """nf AS (SELECT c_custkey AS id, n_name, c_mktsegment, c_acctbal, r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""
