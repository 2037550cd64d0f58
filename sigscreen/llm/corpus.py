"""Tables of a corpus folder, and joins and groupings that many operators here need."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscreen.operators.joins import HOT_SHARE, lookup_join
from sigscreen.runtime import cut_lineage

SMALL_ROWS, SMALL_BYTES = 200_000, 16_000_000     # a table within both bounds is broadcast
LAST = 2**63 - 1
BITS = 1 << 25             # of a map of wanted rows, 4 MB
PAGE_BYTES = 1 << 12       # of one bitmap of Spark's


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, did, fp): did and fp together tell texts apart.

    did is the doc_id, or the largest long where that is null; fp is a hash of the text. Rows that
    agree in both have the same id and text, and get the same result.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("did"),
             F.xxhash64("text").alias("fp"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(df: DataFrame) -> bool:
    """Whether the rows, counted and weighed, are few enough to send to every executor."""
    width = F.lit(0)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(f.name), F.lit(0)) * 8
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        else:
            width = width + 8
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return row["n"] <= SMALL_ROWS and (row["b"] or 0) <= SMALL_BYTES


def beside(big: DataFrame, lookup: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """Join to a written table that is unique on ``key``; it is broadcast only if weighed to be small."""
    return big.join(F.broadcast(lookup) if is_small(lookup) else lookup, key, how)


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key stands in ``wanted`` (key, n), n being their number; rows of a key with a large share are spread by a salt."""
    wanted = cut_lineage(wanted)
    floor = max((wanted.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE, 1000)
    hot = [r[key] for r in wanted.where(F.col("n") > floor).select(key).collect()]        # never more than 1 / HOT_SHARE
    return lookup_join(rows, wanted.select(key), key, "inner", hot)


def maybe_among(rows: DataFrame, wanted: DataFrame, key: list[str], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may stand in ``wanted``, all that do and few others, and the rest, without a shuffle.

    A wanted key sets one bit of a map of so many bits, which every executor gets; more keys let more others through, the map
    stays as it is.
    """
    of, bytes_, maybe = unused(rows, "_page", "_map", "_maybe")
    at = F.pmod(F.xxhash64(*key), F.lit(bits))
    page, bit = F.floor(at / (8 * PAGE_BYTES)), at % (8 * PAGE_BYTES)
    pages = wanted.groupBy(page.alias(of)).agg(F.bitmap_construct_agg(bit).alias(bytes_))
    held = F.conv(F.hex(F.substring(bytes_, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn(of, page).join(F.broadcast(pages), of, "left").withColumn(
        maybe, F.coalesce(F.getbit(held, (bit % 8).cast("int")) == 1, F.lit(False)))
    return told.where(maybe).select(*rows.columns), told.where(~F.col(maybe)).select(*rows.columns)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4: rows with 2 are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def reachable(spark: SparkSession) -> None:
    """Let workers import this package from the folder it was imported from, as a local run needs."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of rows, sorted by the integer columns ``key``, that a task reads; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in key]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            now = tuple(c[lo] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
