"""Materialise one feature row per entity, labeled or not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.functions import columns as C
from sigscreen.operators.clean import dedup_key, dedup_rows
from sigscreen.operators.events import fact_dim_join, hour_stats, merchant_blocks, modal_place
from sigscreen.operators.folds import stratified_folds
from sigscreen.operators.graph import graph_block, oof_neighbor_labels, pair_counts
from sigscreen.operators.text import doc_block, marker_block, message_counts, text_style
from sigscreen.runtime import cut_lineage


@dataclass(frozen=True)
class Wiring:
    """Which column plays which role. Table roles are the keys of ``tables``.

    Roles: entities, labels, messages, docs, pings, towers, transactions, merchants,
    app_events, devices, ip, weather. Only entities and labels are required; a block
    whose tables are absent is left out.
    """

    # The column names of the usual inputs.
    entity: str = "person_id"
    label: str = "home_city"
    src: str = "sender_id"
    dst: str = "recipient_id"
    text: str = "text"
    lang: str = "lang"
    doc_text: str = "doc_text"
    tower: str = "tower_id"
    region: str = "region_code"
    merchant: str = "merchant_id"
    merchant_city: str = "merchant_city"
    online: str = "is_online"
    event_ts: str = "ts"
    signup: str = "signup_at"
    reference_time: str = "2025-07-01 00:00:00"
    age: str = "age"
    attributes: Sequence[str] = ("declared_language", "device")
    device_attributes: Sequence[str] = ("screen_in", "battery")
    self_report: str = "raw_city_text"
    ip_city: str = "ip_city"
    temperature: str = "temp_c"
    city_pattern: str = C.CITY_PATTERN
    marker_pattern: str = C.MARKER_PATTERN
    mention_pattern: str = C.MENTION_PATTERN
    city_prefix: str = "city_"
    per_region: int = 5
    region_prefix: str = "metro_"
    folds: int = 5
    seed: int = 0
    leaks: bool = True
    extra: Mapping[str, str] = field(default_factory=dict)


def assemble_features(spine: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join blocks with one row per key to the spine.

    Every block ends in an aggregate on the key, so the joins reuse its partitioning.
    """
    out = spine
    for block in blocks:
        out = out.join(block, key, "left")
    return out


def label_joined_weather(labels: DataFrame, weather: DataFrame, w: Wiring) -> DataFrame:
    """Mean temperature of the region that the label names: a leak on purpose, to test the flags."""
    means = weather.groupBy(w.region).agg(F.avg(w.temperature).alias("wx_home_region_temp"))
    homes = labels.select(w.entity, C.region_of(w.label, w.per_region, w.region_prefix).alias(
        w.region))
    return fact_dim_join(homes, means, w.region, ["wx_home_region_temp"]).drop(w.region)


def build_features(tables: Mapping[str, DataFrame], wiring: Wiring = Wiring()) -> DataFrame:
    """Wide feature table with ``ref_ts``, one row per entity; the label is not in it."""
    w = wiring
    key = w.entity
    tables = {name: C.clean_nan(df) for name, df in tables.items()}
    everyone = tables["entities"]
    people = dedup_key(everyone, [key], [c for c in everyone.columns if c != key] or [key])
    labels = dedup_key(tables["labels"].select(key, w.label), [key], [w.label])
    labels = labels.where(F.col(w.label).isNotNull())
    spine = people.select(key)
    blocks = []

    def renamed(df: DataFrame, old: str) -> DataFrame:
        return df.withColumnRenamed(old, key)

    if "messages" in tables:
        # Read three times below, so the de-duplicated rows are written once.
        messages = cut_lineage(dedup_rows(tables["messages"]))
        sent = messages.where(F.col(w.src).isNotNull())
        blocks += [renamed(b, w.src) for b in (
            marker_block(sent, w.src, w.text, w.marker_pattern, w.mention_pattern, w.city_prefix),
            text_style(sent, w.src, w.text), message_counts(sent, w.src, w.lang))]
        pairs = cut_lineage(pair_counts(messages, w.src, w.dst))
        blocks.append(renamed(graph_block(pairs), "a"))
        folds = stratified_folds(spine.join(labels, key, "left"), key, w.label, w.folds, w.seed)
        mix = oof_neighbor_labels(pairs, cut_lineage(folds), key, w.label, "nb")
        blocks.append(mix.select(
            key, F.col("nb").alias("nb_modal_city"), F.col("nb_frac").alias("nb_top_frac"),
            "nb_entropy", "nb_labeled_frac"))
    if "pings" in tables and "towers" in tables:
        blocks.append(modal_place(tables["pings"], tables["towers"], key, w.tower, w.region,
                                  "tower_modal_region", "tower_top_frac", "tower_entropy"))
    if "transactions" in tables and "merchants" in tables:
        blocks += merchant_blocks(tables["transactions"], tables["merchants"], key, w.merchant, w.merchant_city, w.online,
                                  w.city_pattern, w.city_prefix)
    if "app_events" in tables:
        blocks.append(hour_stats(tables["app_events"], key, w.event_ts))
    if "devices" in tables:
        devices = tables["devices"].select(key, *w.device_attributes)
        blocks.append(dedup_key(devices, [key], list(w.device_attributes)))

    signup = C.to_time(w.signup, people.schema[w.signup].dataType)
    own = [key, signup.alias("ref_ts"),
           C.days_between(F.lit(w.reference_time).cast("timestamp"), signup).alias("tenure_days"),
           C.to_number(w.age).alias("age"), *w.attributes]
    own += [F.col(c).alias(n) for n, c in w.extra.items()]
    if w.leaks and w.self_report in people.columns:
        own.append(C.norm_category(w.self_report, w.city_pattern, w.city_prefix).alias(
            "declared_city"))
    blocks.append(people.select(*own))
    if w.leaks and "ip" in tables:
        blocks.append(dedup_key(tables["ip"].select(key, w.ip_city), [key], [w.ip_city]))
    if w.leaks and "weather" in tables:
        blocks.append(label_joined_weather(labels, tables["weather"], w))

    out = assemble_features(spine, blocks, key)
    if "docs" in tables:
        out = doc_block(out, tables["docs"], key, w.doc_text, w.marker_pattern,
                        w.mention_pattern, w.city_prefix)
    if "messages" in tables:
        out = out.withColumn("reciprocity", F.coalesce("reciprocity", F.lit(0.0)))
    return out.select(*[c for c in out.columns if c != "ref_ts"], "ref_ts")
