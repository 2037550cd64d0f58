"""Feature block queries: text, graph, place, time, and the assembled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigscreen.operators import events as E
from sigscreen.operators import graph as G
from sigscreen.operators import text as X
from sigscreen.plans.build_features import Wiring, build_features, label_joined_weather
from sigscreen.runtime import cut_lineage
from sigscreen.workload import data as D
from sigscreen.workload.registry import Tables, modal_sql, query, r6

SPACES = (r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda w: w <> '')"


def matches_sql(source: str, key: str, text: str, pattern: str, prefix: str = "") -> str:
    """(key, m, n) of every match of a pattern's group."""
    return (f"SELECT {key}, '{prefix}' || w AS m, count(*) AS n FROM (SELECT {key}, "
            f"unnest(regexp_extract_all({text}, '{pattern}', 1)) AS w FROM {source}) GROUP BY 1, 2")


def style_sql(source: str, key: str, text: str) -> str:
    """Totals and rates per key."""
    return f"""SELECT {key}, total, {r6('coalesce(words, 0)::double / greatest(total, 1)', 'txt_vocab_richness')},
      {r6('urls::double / greatest(total, 1)', 'txt_url_frac')},
      {r6('emoji::double / greatest(total, 1)', 'txt_emoji_frac')}
      FROM (SELECT {key}, sum(len({tokens_sql(text)}))::bigint AS total,
        sum(len(regexp_extract_all({text}, 'http|www\\.'))) AS urls,
        sum(len(regexp_extract_all({text}, '[\\x{{1F300}}-\\x{{1FAFF}}]'))) AS emoji
        FROM {source} WHERE {text} IS NOT NULL GROUP BY 1)
      LEFT JOIN (SELECT {key}, count(DISTINCT w) AS words FROM (SELECT {key},
        unnest({tokens_sql(text)}) AS w FROM {source}) GROUP BY 1) USING ({key})"""


# ---- text -------------------------------------------------------------------------------

@query("text_marker_profile", "WITH c AS (" + matches_sql("conversations", "conv_id", "text", D.WORDS)
       + "), m AS (" + modal_sql("c", "conv_id", "m", "top", "f", "e") + ") SELECT conv_id, "
       f"top AS word_top_city, {r6('f', 'word_top_frac')}, {r6('e', 'word_entropy')} FROM m")
def text_marker_profile(t: Tables):
    return X.text_marker_profile(t.conversations, "conv_id", "text", D.WORDS, "word", "")


@query("text_mentions", "WITH c AS (" + matches_sql("documents", "source", "text", D.NUMBERS, "no_")
       + "), m AS (" + modal_sql("c", "source", "m", "top", "f", "e",
                                 ", sum(n)::bigint AS total") + ") SELECT source, "
       "top AS txt_modal_mention_city, total AS txt_n_city_mentions FROM m")
def text_mentions(t: Tables):
    return X.text_mentions(t.documents, "source", "text", D.NUMBERS, prefix="no_")


@query("marker_block", "WITH c AS (" + matches_sql("documents", "source", "text", D.WORDS)
       + "), m AS (" + modal_sql("c", "source", "m", "top", "f", "e") + "), c2 AS ("
       + matches_sql("documents", "source", "text", D.NUMBERS) + "), m2 AS ("
       + modal_sql("c2", "source", "m", "top2", "f2", "e2", ", sum(n)::bigint AS total")
       + f") SELECT source, top AS txt_flavor_top_city, {r6('f', 'txt_flavor_top_frac')}, "
       f"{r6('e', 'txt_flavor_entropy')}, top2 AS txt_modal_mention_city, "
       "total AS txt_n_city_mentions FROM m FULL JOIN m2 USING (source)")
def marker_block(t: Tables):
    return X.marker_block(t.documents, "source", "text", D.WORDS, D.NUMBERS, "")


@query("text_style", "SELECT conv_id, total AS txt_total_tokens, txt_vocab_richness, txt_url_frac, "
       "txt_emoji_frac FROM (" + style_sql("conversations", "conv_id", "text") + ")")
def text_style(t: Tables):
    return X.text_style(t.conversations, "conv_id", "text")


@query("text_style_pages", "SELECT url_host, total AS txt_total_tokens, txt_vocab_richness, "
       "txt_url_frac, txt_emoji_frac FROM (" + style_sql(
           "(SELECT regexp_extract(url, '^http://([^/]+)', 1) AS url_host, html FROM pages)",
           "url_host", "html") + ")")
def text_style_pages(t: Tables):
    hosts = t.pages.select(F.regexp_extract("url", "^http://([^/]+)", 1).alias("url_host"), "html")
    return X.text_style(hosts, "url_host", "html")


@query("message_counts", "WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations "
       "GROUP BY 1, 2), m AS (" + modal_sql("c", "conv_id", "role", "top", "f", "e",
                                           ", sum(n)::bigint AS total")
       + ") SELECT conv_id, total AS txt_n_messages, top AS txt_lang_dominant FROM m")
def message_counts(t: Tables):
    return X.message_counts(t.conversations, "conv_id", "role")


def doc_sql(entities: str, key: str) -> str:
    """The document block of an entity list, from documents keyed by number."""
    return (f"""dm AS ({modal_sql('dmc', 'doc_id', 'm', 'dtop', 'f', 'e')}),
      docs AS (SELECT e.{key}, (d.doc_id IS NOT NULL)::int::bigint AS doc_present,
        len({tokens_sql('d.text')})::bigint AS doc_len, dtop AS doc_flavor_top_city,
        dsaid AS doc_n_city_mentions FROM {entities} e LEFT JOIN documents d ON e.{key} = d.doc_id
        LEFT JOIN dm ON dm.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(n)::bigint AS dsaid
          FROM dsc GROUP BY 1) s ON s.doc_id = d.doc_id)""")


DOC_COUNTS = ("dmc AS (" + matches_sql("documents", "doc_id", "text", D.WORDS) + "), dsc AS ("
              + matches_sql("documents", "doc_id", "text", D.NUMBERS) + ")")


@query("doc_block", f"WITH {DOC_COUNTS}, {doc_sql('customer', 'c_custkey')} SELECT * FROM docs")
def doc_block(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("c_custkey"), "text")
    return X.doc_block(t.customer.select("c_custkey"), docs, "c_custkey", "text", D.WORDS,
                       D.NUMBERS, "")


# ---- graph ------------------------------------------------------------------------------

DEGREES = """SELECT a, sum(out_n)::bigint AS deg_out, sum(in_n)::bigint AS deg_in,
  count(b) AS deg_total FROM pairs GROUP BY 1"""
RECIPROCITY = """SELECT a, coalesce(avg(CASE WHEN out_n > 0 THEN (EXISTS (SELECT 1 FROM edges r
    WHERE r.src = p.b AND r.dst = p.a))::int::double END), 0) AS share FROM pairs p GROUP BY 1"""


@query("degrees", f"WITH {D.PAIRS} {DEGREES}")
def degrees(t: Tables):
    return G.degrees(D.edges(t), "src", "dst")


@query("reciprocity", f"WITH {D.PAIRS}, r AS ({RECIPROCITY}) "
       f"SELECT a, {r6('share', 'reciprocity')} FROM r")
def reciprocity(t: Tables):
    return G.reciprocity(D.edges(t), "src", "dst")


NEIGHBORS = f"""seen AS (SELECT a, kb.label AS lab, sum(out_n + in_n)::bigint AS n FROM pairs
    JOIN folds kb ON b = kb.id JOIN folds ka ON a = ka.id
    WHERE kb.label IS NOT NULL AND ka.fold <> kb.fold GROUP BY 1, 2),
  mixed AS ({modal_sql('seen', 'a', 'lab', 'nb_modal', 'f', 'e', ', sum(n)::double AS kept')}),
  mix AS (SELECT mixed.*, kept / greatest(1, (SELECT count(b) FROM pairs p WHERE p.a = mixed.a))
    AS labeled FROM mixed)"""


@query("oof_neighbor_labels", f"""WITH {D.PAIRS}, {D.FOLDS}, {NEIGHBORS}
  SELECT a AS id, nb_modal, {r6('f', 'nb_modal_frac')}, {r6('e', 'nb_modal_entropy')},
  {r6('labeled', 'nb_modal_labeled_frac')} FROM mix""")
def oof_neighbor_labels(t: Tables):
    return G.oof_neighbor_labels(D.kept_pairs(t), D.folds(t), "id", "label")


@query("edge_ratios", f"""WITH {D.PAIRS} SELECT a,
  {r6('sum(in_n)::double / greatest(sum(out_n), 1)', 'in_out_ratio')}, count(b) AS partners,
  {r6('greatest(0, ln(sum(out_n + in_n)::double) - sum((out_n + in_n) * ln((out_n + in_n)::double)) / sum(out_n + in_n)::double)', 'partner_entropy')}
  FROM pairs GROUP BY 1""")
def edge_ratios(t: Tables):
    return G.edge_ratios(D.pairs(t))


RELATIONS = ["click", "error", "purchase", "signup", "view"]


@query("relation_degrees", f"""WITH {D.EDGES}, both_ways AS (SELECT src AS a, dst AS b, event_type
  AS rel FROM edges UNION ALL SELECT dst, src, event_type FROM edges) SELECT a, """ + ", ".join(
    f"count(*) FILTER (rel = '{r}') AS {r}_n, count(DISTINCT b) FILTER (rel = '{r}') AS {r}_partners"
    for r in RELATIONS) + " FROM both_ways GROUP BY 1")
def relation_degrees(t: Tables):
    return G.relation_degrees(D.edges(t), "src", "dst", "event_type", RELATIONS)


@query("multi_relations", """WITH u AS (SELECT o_custkey AS src, l_suppkey AS dst, 'buys' AS rel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
  SELECT user_id, (json_extract_string(props, '$.k'))::bigint, 'acts' FROM events),
  s AS (SELECT src AS a, dst AS b, rel FROM u UNION ALL SELECT dst, src, rel FROM u)
  SELECT a, count(*) FILTER (rel = 'acts') AS acts_n, count(DISTINCT b) FILTER (rel = 'acts')
  AS acts_partners, count(*) FILTER (rel = 'buys') AS buys_n, count(DISTINCT b)
  FILTER (rel = 'buys') AS buys_partners FROM s GROUP BY 1""")
def multi_relations(t: Tables):
    tables = {"buys": (D.shipments(t), "id", "l_suppkey"), "acts": (D.edges(t), "src", "dst")}
    return G.relation_degrees(G.union_relations(tables), "src", "dst", "rel", ["acts", "buys"])


@query("neighbor_mean", f"""WITH {D.PAIRS} SELECT a, {r6('avg(c_acctbal)', 'nb_mean_c_acctbal')}
  FROM pairs JOIN customer ON b = c_custkey GROUP BY 1""")
def neighbor_mean(t: Tables):
    return G.neighbor_mean(D.kept_pairs(t), t.customer, "c_custkey", ["c_acctbal"])


@query("role_features", f"""WITH {D.PAIRS}, d AS ({DEGREES}),
  r1 AS (SELECT p.a, avg(deg_out) AS o1, avg(deg_in) AS i1, avg(deg_total) AS t1
    FROM pairs p JOIN d ON d.a = p.b GROUP BY 1),
  r2 AS (SELECT p.a, avg(o1) AS o2, avg(i1) AS i2, avg(t1) AS t2
    FROM pairs p JOIN r1 ON r1.a = p.b GROUP BY 1)
  SELECT d.*, {r6('o1', 'r1_deg_out')}, {r6('i1', 'r1_deg_in')}, {r6('t1', 'r1_deg_total')},
  {r6('o2', 'r2_r1_deg_out')}, {r6('i2', 'r2_r1_deg_in')}, {r6('t2', 'r2_r1_deg_total')}
  FROM d LEFT JOIN r1 USING (a) LEFT JOIN r2 USING (a)""")
def role_features(t: Tables):
    return G.role_features(D.kept_pairs(t))


# ---- places, time, amounts -----------------------------------------------------------------

PLACES = f"""place_n AS (SELECT id, region_code, count(*) AS n FROM shipments
    JOIN supplier_regions ON l_suppkey = s_suppkey GROUP BY 1, 2),
  places AS ({modal_sql('place_n', 'id', 'region_code', 'region', 'f', 'e')})"""
MERCHANTS = f"""parts AS (SELECT p_partkey, p_size > 25 AS is_large, 'city_' ||
    lpad(regexp_extract(p_brand, '(\\d+)', 1),
      greatest(2, length(regexp_extract(p_brand, '(\\d+)', 1)))::int, '0') AS brand FROM part),
  brand_n AS (SELECT id, brand, count(*) AS n FROM shipments JOIN parts ON l_partkey = p_partkey
    GROUP BY 1, 2),
  brands AS ({modal_sql('brand_n', 'id', 'brand', 'city', 'f', 'e')}),
  larges AS (SELECT id, avg(is_large::int::double) AS share FROM shipments
    LEFT JOIN parts ON l_partkey = p_partkey GROUP BY 1)"""


@query("modal_region", f"""WITH {D.SHIPMENTS}, {D.SUPPLIER_REGIONS}, {PLACES}
  SELECT id, region, {r6('f', 'region_frac')}, {r6('e', 'region_entropy')} FROM places""")
def modal_region(t: Tables):
    return E.modal_place(D.shipments(t), D.supplier_regions(t), "id", "l_suppkey", "region_code",
                         "region", "region_frac", "region_entropy")


@query("modal_merchant", f"""WITH {D.SHIPMENTS}, {MERCHANTS}
  SELECT id, city AS merch_modal_city, {r6('f', 'merch_top_frac')} FROM brands""")
def modal_merchant(t: Tables):
    return E.modal_merchant(D.shipments(t), D.messy_parts(t), "id", "l_partkey", "brand", D.BRAND)


@query("bool_share", f"WITH {D.SHIPMENTS}, {MERCHANTS} SELECT id, {r6('share', 'large_share')} "
       "FROM larges")
def bool_share(t: Tables):
    joined = E.fact_dim_join(D.shipments(t), D.messy_parts(t), "l_partkey", ["is_large"], "left")
    return E.bool_share(joined, "id", "is_large", "large_share")


@query("hour_stats", f"""SELECT user_id, {r6('avg(hour(ts))', 'act_hour_mean')},
  {r6('stddev_samp(hour(ts))', 'act_hour_std')}, count(*) AS app_event_count
  FROM events GROUP BY 1""")
def hour_stats(t: Tables):
    return E.hour_stats(t.events, "user_id", "ts")


@query("hour_circular", f"""SELECT user_id, CASE WHEN sqrt(s * s + c * c) > 1e-9 THEN
  round(((atan2(s, c) * 24 / (2 * pi()) + 24) % 24)::double, 6) + 0.0 END AS hour_circ_mean,
  {r6('sqrt(s * s + c * c)', 'hour_concentration')} FROM (SELECT user_id,
    avg(sin(hour(ts) * 2 * pi() / 24)) AS s, avg(cos(hour(ts) * 2 * pi() / 24)) AS c
    FROM events GROUP BY 1)""")
def hour_circular(t: Tables):
    return E.hour_circular(t.events, "user_id", "ts")


@query("tenure", f"""SELECT o_orderkey, floor(date_diff('microsecond', o_orderdate,
  TIMESTAMP '{D.REFERENCE_TIME}') / 86400000000.0)::bigint AS tenure_days FROM orders""")
def tenure(t: Tables):
    return E.tenure(t.orders, "o_orderkey", "o_orderdate", D.REFERENCE_TIME)


@query("amount_shape", f"""WITH m AS (SELECT o_custkey, avg(o_totalprice) AS a, count(*) AS n,
    stddev_samp(o_totalprice) AS s, stddev_pop(o_totalprice) AS sp, sum(o_totalprice) AS t,
    sum(o_totalprice * ln(o_totalprice)) AS l FROM orders GROUP BY 1),
  third AS (SELECT o_custkey, avg(pow(o_totalprice - a, 3)) AS m3 FROM orders
    JOIN m USING (o_custkey) GROUP BY 1)
  SELECT o_custkey, {r6('a', 'amount_mean')}, {r6('s / a', 'amount_cv')},
  CASE WHEN sp > 0 THEN {r6('m3 / pow(sp, 3)', 'x').replace(' AS x', '')} END AS amount_skew,
  {r6('greatest(0, ln(t) - l / t)', 'amount_entropy')} FROM m JOIN third USING (o_custkey)""")
def amount_shape(t: Tables):
    return E.amount_shape(t.orders, "o_custkey", "o_totalprice")


# ---- a leak on purpose, and the whole table ---------------------------------------------------

@query("label_joined_leak", f"""SELECT c_custkey, {r6('temp', 'wx_home_region_temp')} FROM
  (SELECT c_custkey, 'metro_' || (regexp_extract(n_name, '(\\d+)', 1)::bigint // 5)::varchar AS m
   FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN
  (SELECT 'metro_' || (s_nationkey // 5)::varchar AS m, avg(s_acctbal) AS temp
   FROM supplier GROUP BY 1) USING (m)""")
def label_joined_leak(t: Tables):
    labels = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name")
    weather = t.supplier.select(
        F.concat(F.lit("metro_"), F.floor(F.col("s_nationkey") / 5).cast("string")).alias("m"),
        "s_acctbal")
    return label_joined_weather(labels, weather, Wiring(
        entity="c_custkey", label="n_name", region="m", temperature="s_acctbal"))


def feature_tables(t: Tables) -> dict:
    """The test tables in the roles of the feature builder."""
    first = t.orders.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min("o_orderdate").alias("signup_at"))
    people = t.customer.select(
        F.col("c_custkey").alias("person_id"), F.col("c_acctbal").alias("age"),
        F.concat(F.lit("City "), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias(
            "raw_city_text"),
        F.col("c_mktsegment").alias("device"), F.col("c_name").alias("declared_language"))
    # Read by two blocks, so the joined rows are written once.
    shipped = cut_lineage(D.shipments(t).select(F.col("id").alias("person_id"),
                                                F.col("l_suppkey").alias("tower_id"),
                                                F.col("l_partkey").alias("merchant_id")))
    # a number in the label names its region
    known = D.known_segments(t).where("label is not null").select(
        F.col("id").alias("person_id"), F.concat("label", F.lit("_"), F.length("label").cast("string")).alias("home_city"))
    return {
        "entities": people.join(first, "person_id", "left"),
        "labels": known,
        "messages": t.events.select(
            F.col("user_id").alias("sender_id"), "ts", F.col("event_type").alias("lang"),
            F.get_json_object("props", "$.k").cast("bigint").alias("recipient_id"),
            F.concat(F.lit("the "), "event_type", F.lit(" "), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
                     F.when(F.col("user_id") % 3 == 0, " le ").otherwise(" der "), "event_type").alias("text")),
        "docs": t.documents.select(F.col("doc_id").alias("person_id"),
                                   F.col("text").alias("doc_text")),
        "pings": shipped.select("person_id", "tower_id"),
        "towers": D.supplier_regions(t).withColumnRenamed("l_suppkey", "tower_id"),
        "transactions": shipped.select("person_id", "merchant_id"),
        "merchants": D.messy_parts(t).select(
            F.col("l_partkey").alias("merchant_id"), F.col("brand").alias("merchant_city"),
            F.col("is_large").alias("is_online")),
        "app_events": t.events.select(F.col("user_id").alias("person_id"), "ts"),
        "devices": t.customer.select(F.col("c_custkey").alias("person_id"),
                                     F.col("c_acctbal").alias("screen_in"),
                                     F.col("c_nationkey").alias("battery")),
        "ip": t.customer.select(F.col("c_custkey").alias("person_id"),
                                F.col("c_mktsegment").alias("ip_city")),
        "weather": t.supplier.select(
            F.concat(F.lit("metro_"), F.floor(F.col("s_nationkey") / 5).cast("string")).alias("region_code"),
            F.col("s_acctbal").alias("temp_c")),
    }


FEATURE_WIRING = Wiring(city_pattern=r"(?:brand#|city )(\d+)", marker_pattern=D.WORDS,
                        mention_pattern=D.NUMBERS, city_prefix="city_",
                        reference_time=D.REFERENCE_TIME)
MESSAGES = """messages AS (SELECT DISTINCT user_id AS src,
    (json_extract_string(props, '$.k'))::bigint AS dst, ts, event_type, 'the ' || event_type || ' '
      || lpad((event_id % 1000)::varchar, 3, '0') || CASE WHEN user_id % 3 = 0 THEN ' le ' ELSE ' der ' END || event_type AS text FROM events),
  ends AS (SELECT src AS a, dst AS b, 1 AS o, 0 AS i FROM messages
    UNION ALL SELECT dst, src, 0, 1 FROM messages),
  pairs AS MATERIALIZED (SELECT a, b, sum(o)::bigint AS out_n, sum(i)::bigint AS in_n
    FROM ends GROUP BY a, b),
  edges AS (SELECT src, dst FROM messages)"""


@query("assemble_features", f"""WITH {MESSAGES}, {D.FOLDS}, {NEIGHBORS}, {D.SHIPMENTS},
  {D.SUPPLIER_REGIONS}, {PLACES}, {MERCHANTS},
  flavor_n AS ({matches_sql('messages', 'src', 'text', D.WORDS, 'city_')}),
  flavor AS ({modal_sql('flavor_n', 'src', 'm', 'top', 'f', 'e')}),
  said_n AS ({matches_sql('messages', 'src', 'text', D.NUMBERS, 'city_')}),
  said AS ({modal_sql('said_n', 'src', 'm', 'top', 'f', 'e', ', sum(n)::bigint AS total')}),
  style AS ({style_sql('messages', 'src', 'text')}),
  lang_n AS (SELECT src, event_type, count(*) AS n FROM messages GROUP BY 1, 2),
  langs AS ({modal_sql('lang_n', 'src', 'event_type', 'top', 'f', 'e',
                       ', sum(n)::bigint AS total')}),
  deg AS ({DEGREES}), rec AS ({RECIPROCITY}),
  act AS (SELECT user_id, avg(hour(ts)) AS hm, stddev_samp(hour(ts)) AS hs, count(*) AS n
    FROM events GROUP BY 1),
  firsts AS (SELECT o_custkey, min(o_orderdate) AS signup FROM orders GROUP BY 1),
  dmc AS ({matches_sql('documents', 'doc_id', 'text', D.WORDS, 'city_')}),
  dsc AS ({matches_sql('documents', 'doc_id', 'text', D.NUMBERS, 'city_')}),
  {doc_sql('customer', 'c_custkey')},
  wx AS (SELECT 'metro_' || (s_nationkey // 5)::varchar AS m, avg(s_acctbal) AS temp FROM supplier GROUP BY 1)
  SELECT c.c_custkey AS person_id, {r6('wx.temp', 'wx_home_region_temp')}, flavor.top AS txt_flavor_top_city,
    {r6('flavor.f', 'txt_flavor_top_frac')}, {r6('flavor.e', 'txt_flavor_entropy')},
    said.top AS txt_modal_mention_city, said.total AS txt_n_city_mentions,
    style.total AS txt_total_tokens, txt_vocab_richness, txt_url_frac, txt_emoji_frac,
    langs.total AS txt_n_messages, langs.top AS txt_lang_dominant, deg_out, deg_in, deg_total,
    {r6('coalesce(rec.share, 0)', 'reciprocity')}, nb_modal || '_' || length(nb_modal)::varchar AS nb_modal_city,
    {r6('mix.f', 'nb_top_frac')}, {r6('mix.e', 'nb_entropy')}, {r6('labeled', 'nb_labeled_frac')},
    places.region AS tower_modal_region, {r6('places.f', 'tower_top_frac')},
    {r6('places.e', 'tower_entropy')}, brands.city AS merch_modal_city,
    {r6('brands.f', 'merch_top_frac')}, {r6('larges.share', 'merch_online_frac')},
    {r6('act.hm', 'act_hour_mean')}, {r6('act.hs', 'act_hour_std')}, act.n AS app_event_count,
    {r6('c.c_acctbal', 'screen_in')}, c.c_nationkey::bigint AS battery,
    floor(date_diff('microsecond', signup, TIMESTAMP '{D.REFERENCE_TIME}')
      / 86400000000.0)::bigint AS tenure_days, {r6('c.c_acctbal', 'age')},
    c.c_name AS declared_language, c.c_mktsegment AS device,
    'city_' || lpad(c.c_nationkey::varchar, 2, '0') AS declared_city, c.c_mktsegment AS ip_city,
    doc_present, doc_len, doc_flavor_top_city, doc_n_city_mentions, signup::varchar AS ref_ts
  FROM customer c LEFT JOIN flavor ON flavor.src = c.c_custkey
  LEFT JOIN said ON said.src = c.c_custkey LEFT JOIN style ON style.src = c.c_custkey
  LEFT JOIN langs ON langs.src = c.c_custkey LEFT JOIN deg ON deg.a = c.c_custkey
  LEFT JOIN rec ON rec.a = c.c_custkey LEFT JOIN mix ON mix.a = c.c_custkey
  LEFT JOIN places ON places.id = c.c_custkey LEFT JOIN brands ON brands.id = c.c_custkey
  LEFT JOIN larges ON larges.id = c.c_custkey LEFT JOIN act ON act.user_id = c.c_custkey
  LEFT JOIN firsts ON firsts.o_custkey = c.c_custkey
  LEFT JOIN docs ON docs.c_custkey = c.c_custkey
  LEFT JOIN wx ON c.c_acctbal >= 0 AND wx.m = 'metro_' || (length(c.c_mktsegment) // 5)::varchar""")
def assemble(t: Tables):
    wide = build_features(feature_tables(t), FEATURE_WIRING)
    return wide.withColumn("ref_ts", F.col("ref_ts").cast("string"))
