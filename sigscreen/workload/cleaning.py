"""Cleaning, counting, fold and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigscreen.functions.columns import norm_category, region_of
from sigscreen.operators import clean, counts, folds
from sigscreen.operators.events import fact_dim_join
from sigscreen.operators.information import encode_features, feature_types
from sigscreen.plans.screen import labeled_features
from sigscreen.workload import data as D
from sigscreen.workload.registry import Tables, md5_of, modal_sql, query, r6, unpivot_sql


@query("dedup_rows", """SELECT DISTINCT doc_id, md5(text) AS text_md5, lang, source, n_chars
  FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents)""")
def dedup_rows(t: Tables):
    return clean.dedup_rows(t.documents.unionAll(t.documents)).select(
        "doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("dedup_key", """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number()
  OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup_key(t: Tables):
    return clean.dedup_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderpriority")


@query("norm_category", r"""SELECT p_partkey,
  'brand_' || lpad(regexp_extract(trim('  ' || lower(p_brand) || ' '), '(?i)brand[#_ ]?(\d+)', 1),
    greatest(2, length(regexp_extract(p_brand, '(\d+)', 1)))::int, '0') AS brand,
  CASE WHEN regexp_matches(p_name, '(?i)brand[#_ ]?(\d+)') THEN 'x' END AS no_match FROM part""")
def messy_brands(t: Tables):
    untidy = F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))
    return t.part.select("p_partkey", norm_category(untidy, D.BRAND, "brand_").alias("brand"),
                         norm_category("p_name", D.BRAND, "brand_").alias("no_match"))


@query("region_of", """SELECT n_name, 'metro_' || (regexp_extract(n_name, '(\\d+)', 1)::bigint // 5)
  ::varchar AS metro FROM nation""")
def metro(t: Tables):
    return t.nation.select("n_name", region_of("n_name").alias("metro"))


@query("presence_flag", """SELECT c_custkey, (c_custkey IN (SELECT user_id FROM events))::int::bigint
  AS has_event FROM customer""")
def presence_flag(t: Tables):
    users = t.events.select(F.col("user_id").alias("c_custkey"))
    return clean.presence_flag(t.customer.select("c_custkey"), users, "c_custkey", "has_event")


@query("time_fence", """SELECT o_custkey, count(*) AS orders_n FROM orders
  WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def time_fence(t: Tables):
    before = clean.time_fence(t.orders, "o_orderdate", "1998-01-01 00:00:00")
    return before.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_n"))


@query("labeled_features", """SELECT doc_id, lang, source, n_chars, quality::bigint AS quality
  FROM documents JOIN labels USING (doc_id)""")
def labeled(t: Tables):
    return labeled_features(t.documents.select("doc_id", "lang", "source", "n_chars"),
                            t.labels, "doc_id", "quality")


@query("fact_dim_join", """SELECT r_name AS region_code, count(*) AS items,
  round(sum(l_extendedprice)::double, 2) + 0.0 AS price FROM lineitem
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def dim_join(t: Tables):
    joined = fact_dim_join(t.lineitem.select("l_suppkey", "l_extendedprice"),
                           D.supplier_regions(t), "l_suppkey", ["region_code"], "left")
    return joined.groupBy("region_code").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("symmetric_edges", f"WITH {D.EDGES} SELECT src AS a, dst AS b FROM edges "
       "UNION ALL SELECT dst, src FROM edges")
def both_ways(t: Tables):
    return clean.symmetric_edges(D.edges(t), "src", "dst")


@query("stratified_sample", f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER
  (PARTITION BY lang ORDER BY {md5_of('doc_id')}, doc_id) AS rn FROM documents)
  WHERE rn <= 400 // (SELECT count(DISTINCT lang) FROM documents)""")
def stratified_sample(t: Tables):
    return clean.stratified_sample(t.documents.select("doc_id", "lang"), "doc_id", "lang", 400)


# ---- counts ---------------------------------------------------------------------------

@query("modal_category", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders "
       "GROUP BY 1, 2), m AS (" + modal_sql("c", "o_custkey", "o_orderpriority", "prio", "f", "e")
       + f") SELECT o_custkey, prio, {r6('f', 'prio_frac')}, {r6('e', 'prio_entropy')} FROM m")
def modal_category(t: Tables):
    return counts.modal_category(t.orders, "o_custkey", "o_orderpriority", "prio")


@query("entropy_by_key", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events "
       "GROUP BY 1, 2), m AS (" + modal_sql("c", "user_id", "event_type", "x", "f", "e")
       + f") SELECT user_id, {r6('e', 'entropy')} FROM m")
def entropy_by_key(t: Tables):
    return counts.entropy_by_key(t.events, "user_id", "event_type")


@query("share_of_group", f"""SELECT user_id, event_type, n, {r6('n::double / t', 'share')} FROM
  (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t
   FROM events GROUP BY 1, 2)""")
def share_of_group(t: Tables):
    return counts.share_of_group(t.events, "user_id", "event_type")


@query("degree_distinct", f"WITH {D.EDGES} SELECT src, count(DISTINCT dst) AS contacts "
       "FROM edges GROUP BY 1")
def degree_distinct(t: Tables):
    return counts.degree_distinct(D.edges(t), "src", "dst", "contacts")


@query("mode_by_key", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), "
       "m AS (" + modal_sql("c", "source", "lang", "top_lang", "f", "e")
       + ") SELECT source, top_lang FROM m")
def mode_by_key(t: Tables):
    return counts.mode_by_key(t.documents, "source", "lang", "top_lang")


@query("concat_text", f"""SELECT role, part, md5(string_agg(text, ' ' ORDER BY pos)) AS text_md5,
  sum(length(text)) + count(*) - 1 AS chars FROM (SELECT *, (pos - 1) // 200 AS part FROM
  (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY turn,
    {md5_of('conv_id', 'turn')}, conv_id, turn) AS pos FROM conversations)) GROUP BY 1, 2""")
def concat_text(t: Tables):
    whole = counts.concat_text(t.conversations, "role", "text", "turn", ["conv_id", "turn"], 200)
    return whole.select("role", "part", F.md5("text").alias("text_md5"),
                        F.length("text").alias("chars"))


@query("concat_text_by_key", f"""SELECT conv_id, 0::bigint AS part, md5(string_agg(text, ' ' ORDER BY turn,
  {md5_of('conv_id', 'turn')})) AS text_md5, sum(length(text)) + count(*) - 1 AS chars
  FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def concat_text_by_key(t: Tables):
    whole = counts.concat_text(t.conversations, "conv_id", "text", "turn", ["conv_id", "turn"])
    return whole.select("conv_id", "part", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query("marker_counts", rf"""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id,
  unnest(regexp_extract_all(text, '{D.WORDS}', 1)) AS word FROM documents) GROUP BY 1, 2""")
def marker_counts(t: Tables):
    return counts.marker_counts(t.documents, "doc_id", "text", D.WORDS, "word")


@query("coverage", f"WITH {D.CUSTOMER_NUMBERS}, c AS ("
       + unpivot_sql("nums", D.NUMERIC, "id", "double")
       + f") SELECT feature, {r6('count(x)::double / count(*)', 'coverage')} FROM c GROUP BY 1")
def coverage(t: Tables):
    return counts.coverage(D.customer_numbers(t), D.NUMERIC)


@query("label_entropy", f"""SELECT count(*) AS classes, sum(n)::bigint AS rows,
  {r6('greatest(1e-9, ln(sum(n)::double) - sum(n * ln(n::double)) / sum(n)::double)', 'entropy')}
  FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def label_entropy(t: Tables):
    return counts.label_entropy(t.documents, "lang")


def source_predictions(t: Tables):
    """Each document's language, and the most frequent language of its source as the guess."""
    guess = counts.mode_by_key(t.documents, "source", "lang", "predicted")
    return t.documents.select("doc_id", "source", "lang").join(guess, "source")


SOURCE_PREDICTIONS = ("c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), m AS ("
                      + modal_sql("c", "source", "lang", "predicted", "f", "e")
                      + "), preds AS (SELECT doc_id, source, lang, predicted FROM documents "
                      "JOIN m USING (source))")


@query("confusion_matrix", f"""WITH {SOURCE_PREDICTIONS},
  cls AS (SELECT lang AS c FROM preds UNION SELECT predicted FROM preds)
  SELECT a.c AS lang, b.c AS predicted, count(p.doc_id) AS n FROM cls a CROSS JOIN cls b
  LEFT JOIN preds p ON p.lang = a.c AND p.predicted = b.c GROUP BY 1, 2""")
def confusion(t: Tables):
    return counts.confusion_matrix(source_predictions(t), "lang", "predicted")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders "
       "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def top_orders(t: Tables):
    return counts.top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 20,
                        "o_orderkey")


# ---- folds ---------------------------------------------------------------------------------

@query("stratified_folds", f"WITH {D.FOLDS} SELECT id, label, fold::bigint AS fold FROM folds")
def stratified_folds(t: Tables):
    return D.folds(t)


# one group after the other to the fold with the fewest rows
GROUP_FOLDS = f"""RECURSIVE g AS (SELECT c_nationkey, count(*) AS n, row_number() OVER
    (ORDER BY count(*) DESC, {md5_of('c_nationkey')}, c_nationkey) AS p FROM customer GROUP BY 1),
  gf AS (SELECT 0::bigint AS p, NULL::integer AS c_nationkey, 0::bigint AS n, 0::bigint AS fold,
      list_transform(range(least(5, (SELECT count(*) FROM g))), lambda f: 0::bigint) AS loads
    UNION ALL SELECT g.p, g.c_nationkey, g.n, list_position(loads, list_min(loads)) - 1,
      list_transform(loads, lambda l, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN l + g.n ELSE l END)
    FROM gf JOIN g ON g.p = gf.p + 1)"""


@query("group_folds", f"WITH {GROUP_FOLDS} SELECT c_nationkey::bigint AS c_nationkey, n, "
       "fold::bigint AS fold FROM gf WHERE p > 0")
def group_folds(t: Tables):
    return folds.group_folds(t.customer, "c_nationkey")


@query("group_leakage", f"""WITH {D.FOLDS} SELECT c_nationkey::bigint AS c_nationkey,
  count(DISTINCT fold) AS folds FROM folds JOIN customer ON id = c_custkey WHERE fold <> -1
  GROUP BY 1 HAVING count(DISTINCT fold) > 1""")
def group_leakage(t: Tables):
    rows = D.folds(t).join(t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    return folds.group_leakage(rows, "c_nationkey")


@query("holdout", f"""SELECT doc_id, rn <= floor(n * 0.3::double) AS is_test FROM (SELECT doc_id,
  row_number() OVER (PARTITION BY lang ORDER BY {md5_of('doc_id')}, doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def holdout(t: Tables):
    return folds.holdout(t.documents.select("doc_id", "lang"), "doc_id", "lang").select(
        "doc_id", "is_test")


# ---- typing and encoding ----------------------------------------------------------------

TYPED = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]
TYPED_TEXT = TYPED[-3:]


@query("feature_types", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'categorical' AS kind" if c in TYPED_TEXT else
    f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) > 10 THEN 'numeric' ELSE 'categorical' END "
    "FROM lineitem" for c in [*TYPED_TEXT, *TYPED[:-3]]))
def types(t: Tables):
    return feature_types(t.lineitem, TYPED)


@query("encode_features", f"""WITH {D.CUSTOMER_NUMBERS},
  codes AS (SELECT segment, row_number() OVER (ORDER BY {md5_of('segment')}) AS code
    FROM (SELECT DISTINCT segment FROM nums WHERE segment IS NOT NULL))
  SELECT id, {r6('coalesce(hour_mean, (SELECT median(hour_mean) FROM nums))', 'hour_mean')},
    {r6('balance', 'balance')}, {r6('coalesce(code, 0)', 'segment')}
  FROM nums LEFT JOIN codes USING (segment)""")
def encoded(t: Tables):
    return encode_features(D.customer_numbers(t), "id", ["hour_mean", "balance"], ["segment"])
