"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item is a set of two-word shingles at fixed places. Full containment needs every
one of them, so a prefix of one shingle is enough, and the rarest in the corpus is the best. The
shingles of the documents meet those of the benchmark, are counted, and the places of each window's
rarest shingle become candidates. A candidate must start inside the text (position), leave room for
the window (length), and hold exactly its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.corpus import beside, identified, is_small
from sigscreen.runtime import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _shingles(words: Column) -> Column:
    """The hash of each word with the next; of the word alone where it is the last."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, win, m): the windows of each item as words joined by a space, and their lengths."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("ws"))
    items = items.where(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - size, F.lit(0))
    return items.select("item_id", "ws", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "item_id", F.slice("ws", F.col("i") + 1, F.lit(size)).alias("win_words")).select(
        "item_id", F.array_join("win_words", " ").alias("win"), F.size("win_words").alias("m"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, did, fp, n_words, hits and n_hit, n_items, items_sha256, contaminated of each row of (doc_id, text).

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
    window. hits lists (start, m, win): the windows found in the text, by first word. n_hit counts the words inside
    any of them, n_items the different item_ids with found windows, items_sha256 hashes these ids, sorted as
    strings and joined by commas (of nothing where there are none). Null and empty texts have no words, items
    without words no windows. An item with a null id marks words, but is not listed. Repeated rows get the
    same result; did and fp identify the row as ``identified`` does. Other columns are left out.
    """
    docs = identified(docs)
    windows = cut_lineage(windows_of(benchmark, size).distinct())
    wins = windows.select("win", "m").distinct()
    parts = wins.withColumn("ws", F.split("win", " ")).select(
        "win", "m", F.posexplode(F.when(F.col("m") == 1, _shingles(F.col("ws"))).otherwise(
            F.slice(_shingles(F.col("ws")), F.lit(1), F.col("m") - 1))).alias("off", "gram"))
    parts = cut_lineage(parts)

    # the places of benchmark shingles in the documents
    ws = docs.select("did", "fp", words_of(F.col("text")).alias("ws"))
    seen = ws.select("did", "fp", F.posexplode(_shingles(F.col("ws"))).alias("pos", "gram"))
    if not parts.where("m = 1").isEmpty():           # one-word items ask for each word alone as well
        alone = F.transform("ws", lambda w: F.xxhash64(w))
        seen = seen.union(ws.select("did", "fp", F.posexplode(alone)))
    places = cut_lineage(beside(seen, cut_lineage(parts.select("gram").distinct()), "gram", "inner")
                         .select("did", "fp", "pos", "gram"))
    counts = places.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a window whose shingles do not all occur cannot occur
    rarest = parts.join(counts, "gram", "left").groupBy("win", "m").agg(
        F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min(F.struct("df", "off", "gram")).alias("x")
    ).where("least > 0").select("win", "m", "x.off", "x.gram")
    rarest = cut_lineage(rarest)
    found = places.join(F.broadcast(rarest) if is_small(rarest) else rarest, "gram").where("pos >= off").select(
        "did", "fp", (F.col("pos") - F.col("off")).alias("start"), "m", "win")
    found = cut_lineage(found.groupBy("did", "fp").agg(F.collect_set(F.struct("start", "m", "win")).alias("maybe")))

    # exact words at the place, and the counts of every text; each text is shuffled once, however few were found
    ws = F.col("ws")
    same = F.filter("maybe", lambda c: (c["start"] + c["m"] <= F.size(ws)) &
                    (F.array_join(F.slice(ws, c["start"] + 1, c["m"]), " ") == c["win"]))
    read = docs.join(found.hint("merge"), ["did", "fp"], "left").select(
        "doc_id", "did", "fp", words_of(F.col("text")).alias("ws"), "maybe").select(
        "doc_id", "did", "fp", F.size("ws").cast("long").alias("n_words"),
        F.coalesce(same, F.array().cast("array<struct<start:int,m:int,win:string>>")).alias("hits"))
    read = cut_lineage(read)
    items = read.where(F.size("hits") > 0).select("did", "fp", F.explode("hits.win").alias("win")).distinct()
    items = items.join(windows.select("win", "item_id"), "win").groupBy("did", "fp").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda c: F.sequence(c["start"], c["start"] + c["m"] - 1))))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return read.join(cut_lineage(items), ["did", "fp"], "left").select(
        "doc_id", "did", "fp", "n_words", "hits", F.size(covered).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def digests(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    return contamination(docs, benchmark, size).drop("did", "fp", "hits")
