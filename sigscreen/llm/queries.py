"""The corpus queries by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscreen.llm import (
    align,
    blocks,
    count,
    decontaminate,
    encode,
    language,
    near,
    negatives,
    neighbors,
    pii,
    suffixes,
    toxicity,
    windows,
)
from sigscreen.llm.corpus import reachable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


@query
def op1_bpe(spark, sf_dir):
    return encode.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


ORACLES["op3_near_duplicates"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_FOLD}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws) > 1
      THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS sh FROM w),
  x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d),
  m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, len(sh)::bigint AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON d = doc_id"""


@query
def op4_decontamination(spark, sf_dir):
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


_WORDS = rf"list_filter(string_split_regex({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
  bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + 9], ' ') AS win
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
  dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, ws, m,
    unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
  hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (m, win)),
  word AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS w FROM hit) GROUP BY doc_id),
  item AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""


@query
def op5_token_blocks(spark, sf_dir):
    return blocks.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbors.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, relax=1.0)


ORACLES["op6_nearest"] = """
WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::integer AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op7_suffix_dedup(spark, sf_dir):
    return suffixes.digests(table(spark, sf_dir, "documents"), length=400)


@query
def op8_repeated_windows(spark, sf_dir):
    return windows.digests(table(spark, sf_dir, "documents"), size=50)


ORACLES["op8_repeated_windows"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
  f AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
  hit AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN f USING (s), range(0, 50) t(k) WHERE least < doc_id),
  word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
    FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, len(ws)::bigint - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


@query
def op9_token_counts(spark, sf_dir):
    return count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op12_personal_data(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


def _luhn(digits: str) -> str:
    return (f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::int "
            "ELSE 2 * c::int - 9 * (c::int > 4)::int END)) % 10 = 0")


_SCORE = "\n".join(
    f"WHEN kind = '{k}' THEN {pii.POINTS[k]} + {pii.CHECKED} * (kind IN ('card', 'iban'))::int "
    f"+ {pii.FOR} * regexp_matches(near, '{pii.SPEAKS_FOR[k]}')::int - {pii.AGAINST} * regexp_matches(near, '{pii.SPEAKS_AGAINST}')::int"
    for k in pii.KINDS)
# gaps and matches in turn give each match its place
ORACLES["op12_personal_data"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
  p(kind, k, pat) AS (VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
    ('ip', 2, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), ('card', 3, '[0-9]([\x20-]?[0-9])+'),
    ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]'), ('iban', 5, '\b[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}\b'),
    ('ssn', 6, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b')),
  m AS (SELECT r, x, kind, k, string_split_regex(x, pat) AS gaps, regexp_extract_all(x, pat) AS hits FROM d, p),
  h AS (SELECT r, x, kind, k, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
  w AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM h),
  part AS (SELECT r, x, parts[i] AS hit, s + coalesce(list_sum(list_transform(parts[1:i - 1], lambda g: length(g) + 1)), 0) AS s
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT r, x, s, string_split_regex(hit, '[ -]') AS parts FROM w WHERE kind = 'card' AND length(digits) > 19))),
  c AS (
    SELECT r, x, kind, k, hit, s, true AS base FROM w WHERE CASE kind WHEN 'email' THEN true
      WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda q: length(ltrim(q, '0')) > 3
        OR (length(ltrim(q, '0')) = 3 AND ltrim(q, '0') > '255'))) = 0
      WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND {_luhn("digits")}
      WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE false END
    UNION ALL SELECT r, x, 'card', 3, hit, s, false FROM part
      WHERE length(hit) BETWEEN 13 AND 19 AND hit[1] IN ('3', '4', '5', '6') AND {_luhn("hit")}
    UNION ALL SELECT r, x, kind, k, hit, s, false FROM w WHERE kind = 'ssn' OR (kind = 'iban' AND list_reduce(list_prepend(0,
      list_transform(string_split(replace(hit, ' ', '')[5:] || hit[1:4], ''), lambda q: CASE WHEN q BETWEEN '0' AND '9'
        THEN q::int ELSE ascii(q) - 55 END)), lambda a, q: (CASE WHEN q > 9 THEN 100 ELSE 10 END * a + q) % 97) = 1)),
  f AS (SELECT *, kind || ':' || s::bigint || ':' || (s + length(hit))::bigint AS shown FROM (SELECT *,
    translate(x[greatest(s - {pii.NEARBY}, 0)::bigint + 1:s::bigint], '{_UPPER}', '{_LOWER}') AS near FROM c)
    WHERE base OR CASE {_SCORE} END >= {pii.KEEP}),
  a AS (SELECT r, {", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in pii.KINDS[:4])},
    string_agg(shown, ',' ORDER BY s, k) FILTER (base) AS b, string_agg(shown, ',' ORDER BY s, k) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint AS n_{k}" for k in pii.KINDS[:4])},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


@query
def op13_token_alignment(spark, sf_dir):
    return align.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                         public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::bigint AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::integer AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
