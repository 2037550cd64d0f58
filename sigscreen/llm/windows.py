"""Repeated passages by Rabin-Karp hashes of every fixed-length window of words.

Every quarter-length window is hashed, and of the full ones those that may stand twice. First the anchors of the
windows are counted in Spark: the anchor of a window is the quarter-length one inside it with the
least hash, so equal windows have equal anchors, and neighbors share theirs. Only runs of windows
whose anchor several documents share go on, and their windows are told apart by 96 bits of two hashes. Equal runs are kept once, their windows
are counted with the least document of each, and every copy of a run is told the outcome.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.corpus import among, identified
from sigscreen.llm.texts import Poly, U, anchors, chunks, find_words, signed, word_hashes
from sigscreen.runtime import cut_lineage


def _gram(size: int) -> int:
    """The words of an anchor."""
    return max(1, size // 4)


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(did, fp, run, gram): anchors of each text, and the windows they stand for, first << 32 | last."""
    part_size = _gram(size)

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2)):
                words = find_words(part)
                grams = Poly(word_hashes(part, words)).windows(part_size)
                at, run, row = [], [], []
                for i in range(part.hi - part.lo):
                    lo, hi = words.first[i], words.first[i + 1]
                    if hi - lo >= size:
                        place, first, last = anchors(grams[lo:hi - part_size + 1], size - part_size + 1)
                        at.append(place + lo)
                        run.append(first << 32 | last)
                        row.append(np.full(len(place), i))
                if not at:
                    continue
                at, run, row = map(np.concatenate, (at, run, row))
                rows = [batch.column(j).slice(part.lo, part.hi - part.lo).take(pa.array(row)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(run), pa.array(signed(grams[at]))],
                                                 ["did", "fp", "run", "gram"])

    return docs.select("did", "fp", "text").mapInArrow(run, "did long, fp long, run long, gram long")


def _run_rows(docs: DataFrame, size: int) -> DataFrame:
    """(did, fp, first, n, whole, hashes, checks): the windows of each run that ``docs`` lists in ``runs``.

    hashes and checks, half as long and by another base, have one per window; whole is the hash of all words of the run, so runs with the same whole, n and first hash are equal.
    """
    part_size = _gram(size)

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2)):
                words = find_words(part)
                poly = Poly(word_hashes(part, words))
                other = Poly(word_hashes(part, words, which=1), 1)
                listed = batch.column(3).slice(part.lo, part.hi - part.lo)
                row = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy())
                code = listed.flatten().to_numpy()
                if not len(code):
                    continue
                base = words.first[row]
                first, last = (code >> 32) + base, (code & 0xFFFFFFFF) + base
                n = last - first + 1
                ends = np.cumsum(n)
                start = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first, n)
                hashes = signed(other.runs(start, start + size))
                checks = (poly.runs(start, start + size) & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                places = pa.array(np.append(0, ends).astype(np.int32))
                rows = [batch.column(j).slice(part.lo, part.hi - part.lo).take(pa.array(row)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array((first - base).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(signed(poly.runs(first, last + size))),
                     pa.ListArray.from_arrays(places, pa.array(hashes)), pa.ListArray.from_arrays(places, pa.array(checks))],
                    ["did", "fp", "first", "n", "whole", "hashes", "checks"])

    return docs.select("did", "fp", "text", "runs").mapInArrow(
        run, "did long, fp long, first int, n int, whole long, hashes array<long>, checks array<int>")


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words outside the windows that start at ``flagged``."""
    def run(batches):
        for batch in batches:
            col = batch.column(1)
            for part in chunks(col):
                words = find_words(part)
                flagged = batch.column(2).slice(part.lo, part.hi - part.lo).to_pylist()
                total, removed, kept = [], [], []
                for i, at in enumerate(flagged):
                    lo, hi = words.first[i], words.first[i + 1]
                    cover = np.zeros(hi - lo + 1, np.int64)
                    if at:
                        at = np.array(at)
                        cover[at] += 1
                        cover[at + size] -= 1
                    keep = np.flatnonzero(np.cumsum(cover)[:-1] == 0) + lo
                    raw = part.data
                    kept.append(b" ".join([raw[s:e].tobytes() for s, e in
                                           zip(words.starts[keep].tolist(), words.ends[keep].tolist())]).decode())
                    total.append(hi - lo)
                    removed.append(hi - lo - len(keep))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(total, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select("doc_id", "text", "flagged").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_text string")


def repeated_windows(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row of (doc_id, text).

    Words are runs of other than white space, unchanged. A word goes if it is inside a
    window of ``size`` words (2 at least) that also starts in a document with a smaller doc_id;
    kept_text joins the others by one space. Texts with fewer words lose nothing; a null text has no words. A
    null doc_id counts as the largest. Rows with the same id are one document, so none of them is
    smaller than another, and a repeated row gets the same result. Other columns are left out.
    """
    docs = identified(docs)
    found = _anchor_rows(docs, size)
    shared = found.groupBy("gram").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    near = cut_lineage(among(found, shared.select("gram", "n"), "gram").groupBy("did", "fp").agg(
        F.collect_set("run").alias("runs")))
    runs = cut_lineage(_run_rows(docs.join(near, ["did", "fp"]), size))
    # equal runs once, with the least document that has them
    same = ["whole", "n", "h0"]
    runs = runs.withColumn("h0", F.get("hashes", F.lit(0)))
    distinct = cut_lineage(runs.groupBy(*same).agg(F.min("did").alias("did"), F.min(F.struct("hashes", "checks")).alias("marks")))
    windows = distinct.select(*same, "did", F.posexplode(F.arrays_zip("marks.hashes", "marks.checks")).alias("at", "mark")).select(
        *same, "did", "at", F.col("mark.hashes").alias("h"), F.col("mark.checks").alias("check"))
    first = windows.groupBy("h", "check").agg(F.min("did").alias("least"))
    leasts = cut_lineage(windows.drop("did").join(first, ["h", "check"]).groupBy(*same).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda x: x["least"]).alias("leasts")))
    flagged = runs.select("did", "fp", "first", *same).join(leasts, same).select(
        "did", "fp", F.col("first"), F.posexplode("leasts").alias("at", "least")).where("did > least").groupBy("did", "fp").agg(
        F.collect_set(F.col("first") + F.col("at")).alias("flagged"))
    return _cut(docs.join(cut_lineage(flagged), ["did", "fp"], "left"), size)


def digests(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words."""
    return repeated_windows(docs, size).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
