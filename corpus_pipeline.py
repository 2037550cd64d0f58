"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of documents. Columns beyond those the stages read pass through unchanged.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sigscreen.llm import decontaminate, encode, language, near, suffixes  # noqa: E402
from sigscreen.llm.corpus import LAST, maybe_among, reachable, table, unused  # noqa: E402
from sigscreen.runtime import cut_lineage, shared_folder  # noqa: E402

SIZE = 5                   # words in a near-duplicate shingle
SAME_WORDS = 51            # a passage of so many words that stands elsewhere goes,
SAME_BYTES = 256           # and one of so many bytes
TOKENIZER = "word_bpe_49k.json"


def _keyed(docs: DataFrame, did: str, fp: str) -> DataFrame:
    """With two more columns, as ``corpus.identified`` makes them, to join a stage's decisions to whole rows."""
    return docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(
        fp, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence. Those without a letter, or rejected, go: null and empty texts too.

    Rows with one text stay or go together, whatever their ids.
    """
    reachable(spark)
    return language.recognized(docs, language.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, and one row of it.

    Texts without words are near none, so they stay; of rows that agree in id and text one stays. A null id is the largest.
    """
    reachable(spark)
    did, fp, n = unused(docs, "did", "fp", "n")
    kept = near.near_duplicates(docs, size=SIZE, percent=80, keys=True).where("kept")
    kept = cut_lineage(kept.groupBy(F.col("did").alias(did), F.col("fp").alias(fp)).agg(F.count(F.lit(1)).alias(n)))
    rows = _keyed(docs, did, fp).join(kept, [did, fp])
    again = rows.where(F.col(n) > 1).dropDuplicates([did, fp])         # only rows that repeat are compared
    return rows.where(F.col(n) == 1).union(again).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand elsewhere; characters cut in two go whole. n_chars follows the text.

    All rows stay, null and empty texts as they are; a repeated row's text is all repeat, so nothing of it is left.
    """
    reachable(spark)
    did, fp, left = unused(docs, "did", "fp", "kept")
    cut = suffixes.shortened(docs, 2 * SAME_WORDS - 1, (SAME_BYTES, SAME_WORDS))
    cut = cut_lineage(cut.select(F.col("did").alias(did), F.col("fp").alias(fp), F.col("kept").alias(left)))
    some, others = maybe_among(_keyed(docs, did, fp), cut, [did, fp])
    rows = some.join(cut, [did, fp], "left")
    clean = F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(F.col(left).cast("string"))), "�", "")
    rows = rows.withColumn("text", F.when(F.col(left).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns).union(others.select(*docs.columns))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    reachable(spark)
    did, fp = unused(docs, "did", "fp")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    clean = found.where(~F.col("contaminated")).select(F.col("did").alias(did), F.col("fp").alias(fp)).dropDuplicates([did, fp])
    return _keyed(docs, did, fp).join(cut_lineage(clean), [did, fp]).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of the ids and of the decoded text, and the ids, of each row; a null or empty text has no ids."""
    reachable(spark)
    done = encode.encode(docs, public_tokenizers.path(TOKENIZER))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontamination", not_in_benchmark),
    ("bpe", tokens),
]

# a trained model decides the first stage, so SQL can't tell the rows; tests/llm compares each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
