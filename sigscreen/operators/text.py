"""Text features by entity: markers, mentions, style, message counts, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions import columns as C
from sigscreen.operators.clean import dedup_key
from sigscreen.operators.counts import (
    entropy_of, marker_counts, mode_by_key, summarise_counts, top_category)
from sigscreen.runtime import cut_lineage


def text_marker_profile(df: DataFrame, key: str, text: str, pattern: str = C.MARKER_PATTERN,
                        out: str = "txt_flavor", prefix: str = "city_") -> DataFrame:
    """Most frequent marker, its share and the entropy of all markers."""
    counts = marker_counts(df, key, text, pattern, "_marker", prefix)
    return summarise_counts(counts, key, "_marker", f"{out}_top_city", f"{out}_top_frac",
                            f"{out}_entropy")


def text_mentions(df: DataFrame, key: str, text: str, pattern: str = C.MENTION_PATTERN,
                  top: str = "txt_modal_mention_city", total: str = "txt_n_city_mentions",
                  prefix: str = "city_") -> DataFrame:
    """Most frequent explicit mention and the number of mentions."""
    counts = marker_counts(df, key, text, pattern, "_marker", prefix)
    return summarise_counts(counts, key, "_marker", top, total=total)


def marker_block(df: DataFrame, key: str, text: str, marker: str = C.MARKER_PATTERN,
                 mention: str = C.MENTION_PATTERN, prefix: str = "city_") -> DataFrame:
    """``text_marker_profile`` and ``text_mentions`` in one scan and one shuffle."""
    def tagged(kind: int, pattern: str):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda m: F.struct(
            F.lit(kind).alias("kind"), F.concat(F.lit(prefix), m).alias("m")))

    hits = df.where(F.col(text).rlike(f"(?:{marker})|(?:{mention})")).select(
        key, F.explode(F.concat(tagged(1, marker), tagged(2, mention))).alias("_h"))
    counts = hits.groupBy(key, F.col("_h.kind").alias("_kind"), F.col("_h.m").alias("_m")).agg(
        F.count(F.lit(1)).alias("n"))
    one, two = F.col("_kind") == 1, F.col("_kind") == 2
    # Nulls from the other kind are skipped by every aggregate.
    counts = counts.select(
        key, F.when(one, F.col("_m")).alias("m1"), F.when(one, F.col("n")).alias("n1"),
        F.when(two, F.col("_m")).alias("m2"), F.when(two, F.col("n")).alias("n2"))
    return counts.groupBy(key).agg(
        F.min_by("m1", F.when(F.col("n1").isNotNull(), F.struct(-F.col("n1"), F.col("m1")))
                 ).alias("txt_flavor_top_city"),
        (F.max("n1") / F.sum("n1")).alias("txt_flavor_top_frac"),
        F.when(F.sum("n1").isNotNull(), F.greatest(F.lit(0.0), F.ln(F.sum("n1")) - F.sum(
            C.xlogx("n1")) / F.sum("n1"))).alias("txt_flavor_entropy"),
        F.min_by("m2", F.when(F.col("n2").isNotNull(), F.struct(-F.col("n2"), F.col("m2")))
                 ).alias("txt_modal_mention_city"),
        F.sum("n2").cast("bigint").alias("txt_n_city_mentions"))


def text_style(df: DataFrame, key: str, text: str, prefix: str = "txt") -> DataFrame:
    """Token total, distinct-token share, url rate and emoji rate; denominators are at least 1.

    Everything but the distinct count adds up over texts, and distinct tokens are
    counted from (key, token) pairs, so texts need not be joined per key.
    """
    rows = df.where(F.col(text).isNotNull())
    marks = rows.groupBy(key).agg(
        F.sum(F.regexp_count(text, F.lit(C.URL_PATTERN))).alias("_urls"),
        F.sum(F.regexp_count(text, F.lit(C.EMOJI_PATTERN))).alias("_emoji"))
    pairs = rows.select(key, F.explode(C.tokens(text)).alias("_t")).groupBy(key, "_t").agg(
        F.count(F.lit(1)).alias("n"))
    words = pairs.groupBy(key).agg(F.sum("n").alias("_total"), F.count("_t").alias("_distinct"))
    total = F.coalesce(F.col("_total"), F.lit(0))
    floor = F.greatest(total, F.lit(1))
    return marks.join(words, key, "left").select(
        key, total.cast("bigint").alias(f"{prefix}_total_tokens"),
        (F.coalesce(F.col("_distinct"), F.lit(0)) / floor).alias(f"{prefix}_vocab_richness"),
        (F.col("_urls") / floor).alias(f"{prefix}_url_frac"),
        (F.col("_emoji") / floor).alias(f"{prefix}_emoji_frac"))


def message_counts(df: DataFrame, key: str, lang: str, count: str = "txt_n_messages",
                   dominant: str = "txt_lang_dominant") -> DataFrame:
    """Messages per key, those without text included, and the most frequent language."""
    # Null languages stay in the counts as their own row, so one shuffle gives both answers.
    counts = df.groupBy(key, lang).agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col(lang).isNotNull(), F.struct(-F.col("n"), F.col(lang)))
    return counts.groupBy(key).agg(
        F.sum("n").cast("bigint").alias(count), F.min_by(F.col(lang), rank).alias(dominant))


def doc_block(spine: DataFrame, docs: DataFrame, key: str, text: str,
              marker: str = C.MARKER_PATTERN, mention: str = C.MENTION_PATTERN,
              prefix: str = "city_") -> DataFrame:
    """Per spine entity: has a document, its length in tokens, top marker, mention count.

    One document per entity is kept, and what is needed of its text is taken from the row at once; texts travel no
    further, and the three answers come from the short table that is left.
    """
    docs = dedup_key(docs.select(key, text), [key], [text])
    facts = cut_lineage(docs.select(
        key, F.size(C.tokens(text)).cast("bigint").alias("doc_len"), F.regexp_extract_all(text, F.lit(marker), F.lit(1)).alias("_marks"),
        F.size(F.regexp_extract_all(text, F.lit(mention), F.lit(1))).cast("bigint").alias("_said")))
    marks = facts.select(key, F.explode("_marks").alias("_m")).groupBy(key, F.concat(F.lit(prefix), F.col("_m")).alias("_m")).agg(
        F.count(F.lit(1)).alias("n"))
    top = summarise_counts(marks, key, "_m", "doc_flavor_top_city")
    own = facts.select(key, F.lit(1).alias("doc_present"), "doc_len", F.when(F.col("_said") > 0, F.col("_said")).alias("doc_n_city_mentions"))
    out = spine.join(own, key, "left").join(top, key, "left")
    return out.select(*spine.columns, F.coalesce("doc_present", F.lit(0)).alias("doc_present"), "doc_len", "doc_flavor_top_city",
                      "doc_n_city_mentions")


__all__ = ["doc_block", "entropy_of", "marker_block", "message_counts", "mode_by_key",
           "text_marker_profile", "text_mentions", "text_style", "top_category"]
