"""Repeated byte strings by sorting suffixes in range-partitioned buckets.

A suffix is taken at each anchor. The anchor of a string is the place in it where a run of a quarter of
the string's length has the least hash, so equal strings have theirs at the same place. Runs are counted, and
a bit map of those that stand more than once goes to every task, so most other suffixes are never made.

The rest travel with their leading bytes and with the few bytes that precede them. Spark samples
splitters and partitions them by range of their leading run; a run that more than ``HOT`` different
suffixes share is ranged by all its bytes, so it may fill many buckets. A bucket sorts its suffixes by multikey
quicksort. Strings are equal when neighbors agree on the bytes after the anchor and hold equal bytes
before it. Where a run is split, the strings that may stand in the next bucket as well are compared across
buckets by a grouping on their hashes. Equal suffixes are counted, then kept once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.corpus import PAGE_BYTES, beside, identified, maybe_among
from sigscreen.llm.texts import BASES, SYMBOLS, U, Chunk, Poly, anchors, chunks, find_words, giving_back, merged, mix, powers, signed
from sigscreen.runtime import cut_lineage

HOT = 20_000               # suffixes with one leading run that a bucket takes unsplit
MOST_BITS = 1 << 28        # of the map of runs that stand more than once, 32 MB


def _split(length: int) -> tuple[int, int]:
    """The length of an anchor's run, and the most bytes before it in its string."""
    gram = max(1, length // 4)
    return gram, length - gram


def _anchors(part: Chunk, length: int) -> tuple[np.ndarray, ...]:
    """(row, at, lo, hi, gram) of the anchors of a chunk: at is a place in its data, and the strings start lo to hi bytes before it."""
    size, ahead = _split(length)
    grams = Poly(SYMBOLS[0][part.data]).windows(size)
    out = []
    for i in range(part.hi - part.lo):
        lo, hi = part.offsets[i], part.offsets[i + 1]
        if hi - lo >= length:
            at, first, last = anchors(grams[lo:hi - size + 1], ahead + 1)
            out.append((np.full(len(at), i), at + lo, at - last, at - first, grams[at + lo]))
    return tuple(map(np.concatenate, zip(*out))) if out else (*[np.zeros(0, np.int64)] * 4, np.zeros(0, U))


def _gram_rows(docs: DataFrame, length: int) -> DataFrame:
    """(gram): the run of each anchor of each text."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(signed(_anchors(part, length)[4]))], ["gram"])

    return docs.select("text").mapInArrow(giving_back(run), "gram long")


def _often(docs: DataFrame, length: int) -> np.ndarray:
    """A map of the anchors' runs that stand more than once: such a run's low bits name a bit that is set.

    A few others share a bit with one of them. The map has some 32 bits for each run, up to ``MOST_BITS``.
    """
    found = cut_lineage(_gram_rows(docs, length).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    bits = min(MOST_BITS, max(8 * PAGE_BYTES, 1 << (32 * found.count()).bit_length()))
    page = F.floor(F.col("gram").bitwiseAND(F.lit(bits - 1)) / (8 * PAGE_BYTES)).alias("page")
    bit = F.col("gram").bitwiseAND(F.lit(8 * PAGE_BYTES - 1))
    out = np.zeros((bits // 8 // PAGE_BYTES, PAGE_BYTES), np.uint8)
    for r in found.groupBy(page).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _suffix_rows(docs: DataFrame, length: int, often: np.ndarray) -> DataFrame:
    """(did, fp, at, id, lo, hi, before, after) of the anchors whose run may stand more than once by the map ``often``.

    The strings of an anchor start lo to hi bytes before it; id is the same for equal suffixes.
    """
    schema = "did long, fp long, at int, id binary, lo int, hi int, before binary, after binary"
    names = ["did", "fp", "at", "id", "lo", "hi", "before", "after"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        seen = sent.value
        for batch in batches:
            for part in chunks(batch.column(2)):
                *places, gram = _anchors(part, length)
                code = gram & U(8 * len(seen) - 1)
                keep = np.flatnonzero(seen[code >> U(3)] >> (code & U(7)).astype(np.uint8) & 1)
                did, fp = (batch.column(j).slice(part.lo, part.hi - part.lo).to_pylist() for j in (0, 1))
                base, data = part.offsets.tolist(), part.data.tobytes()
                for s in range(0, len(keep), 20_000):
                    out = []
                    for i, at, lo, hi in zip(*(c[keep[s:s + 20_000]].tolist() for c in places)):
                        before, after = data[at - hi:at], data[at:at + length - lo]
                        mark = hashlib.blake2b(b"%d:%d:" % (lo, hi) + before + after, digest_size=16).digest()
                        out.append((did[i], fp[i], at - base[i], mark, lo, hi, before, after))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select("did", "fp", "text").mapInArrow(giving_back(run), schema)


def multikey_quicksort(words: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """The order of rows of big-endian 64-bit words: three-way partitions, the equal part by the next word."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            if hi - lo > 1:                                     # equal but for their length
                order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda i: len(raw[i]))
            continue
        part = order[lo:hi]
        if hi - lo <= 64:
            order[lo:hi] = sorted(part.tolist(), key=raw.__getitem__)
            continue
        v = words[part, depth]
        pivot = np.sort(v[:: max(1, len(v) // 63)])
        pivot = pivot[len(pivot) // 2]
        less, equal = v < pivot, v == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum() + equal.sum())
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~less & ~equal]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _bytes_matrix(col: pa.Array, width: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a binary column, padded with zeros on their right or left, and their lengths."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(ends)
    out = np.zeros((len(col), width), np.uint8)
    row = np.repeat(np.arange(len(col)), size)
    place = np.arange(int(size.sum())) - np.repeat(ends[:-1] - ends[0], size)
    if not right:
        place = np.repeat(size, size) - 1 - place               # backward from the anchor
    out[row, place] = data[ends[0]:ends[-1]]
    return out, size


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _bucket(table: pa.Table, length: int):
    """Flagged runs (id, lo, hi) of a bucket, and (id, lo, hi, window) of what other buckets may hold; id is null where flagged."""
    size, ahead = _split(length)
    width = -(-length // 8) * 8
    after, after_len = _bytes_matrix(table.column("after"), width, True)
    raw = table.column("after").to_pylist()
    words = np.ascontiguousarray(after).view(">u8").astype(U)
    order = multikey_quicksort(words, raw)
    after, after_len = after[order], after_len[order]
    before, _ = _bytes_matrix(table.column("before"), length, False)
    before = before[order]
    ids = table.column("id").combine_chunks().take(pa.array(order))
    lo, hi = (table.column(c).to_numpy()[order] for c in ("lo", "hi"))
    n = len(order)
    common = np.zeros(n, np.int64)                              # bytes shared with the row above
    for s in range(1, n, 4096):
        differ = after[s:s + 4096] != after[s - 1:min(s + 4096, n) - 1][:len(after[s:s + 4096])]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[s:s + 4096] = np.minimum(first, np.minimum(after_len[s:s + 4096], after_len[s - 1:min(s + 4096, n) - 1]))
    top = int(hi.max(initial=0))
    up, _ = powers(BASES[0], length + 1)
    flags = np.zeros((n, top + 1), bool)
    back = np.zeros(n, U)                                       # hash of the o bytes before the anchor
    for o in range(top + 1):
        if o:
            back = back + SYMBOLS[0][before[:, o - 1]] * up[o]
        use = np.flatnonzero((lo <= o) & (o <= hi))
        if len(use) > 1:
            run = np.cumsum(common < length - o)
            key = mix(back[use] + mix(run[use].astype(U)))
            order2 = np.argsort(key, kind="stable")
            same = key[order2][1:] == key[order2][:-1]
            hit = np.zeros(len(use), bool)
            hit[order2[1:][same]] = True
            hit[order2[:-1][same]] = True
            flags[use[hit], o] = True
    row, first, last = _runs(flags)
    none = pa.nulls(len(row), pa.binary())
    names = ["id", "lo", "hi", "window"]
    if len(row):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(first.astype(np.int32)),
                                          pa.array(last.astype(np.int32)), none], names)
    # For the comparison across buckets: what a row shares with a row of an earlier bucket it also shares
    # with all rows above it here, and so downward. That bounds which of its strings can stand there.
    least = np.full(n, length)
    least[1:] = np.minimum.accumulate(common[1:])
    upward = np.full(n, length)
    upward[:-1] = np.minimum.accumulate(common[:0:-1])[::-1]
    hot = table.column("hot").to_numpy(zero_copy_only=False)[order]
    begin = np.where(hot, np.maximum(lo, length - np.maximum(least, upward)), length + 1)
    left = table.column("before").to_pylist()
    out, told = [], set()
    for i in np.flatnonzero(begin <= hi).tolist():
        text, at = left[order[i]] + raw[order[i]], int(hi[i])
        for o in range(int(begin[i]), at + 1):
            mark = hashlib.blake2b(text[at - o:at - o + length], digest_size=16).digest()
            if not flags[i, o]:
                out.append((ids[i].as_py(), o, o, mark))
            elif mark not in told:              # flagged already; it only has to be known to other buckets
                told.add(mark)
                out.append((None, o, o, mark))
        if len(out) >= 50_000:
            yield _outer_batch(out, names)
            out = []
    if out:
        yield _outer_batch(out, names)


def _outer_batch(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _enough(lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int,
            enough: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs lo..hi those whose strings, started at every byte, cover so many bytes or whole words of ``starts`` and ``ends``."""
    lo, hi = merged(lo, hi - length + 1)               # as starts of strings: a gap of one breaks a repeated passage
    hi = hi + length - 1
    whole = np.searchsorted(ends, hi, "right") - np.searchsorted(starts, lo)
    keep = (hi - lo >= enough[0]) | (whole >= enough[1])
    return merged(lo[keep], hi[keep])


def _cut(docs: DataFrame, length: int, enough: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, did, fp, n_bytes, n_removed, n_spans and the remaining bytes, without the runs ``gone`` that are long ``enough``."""
    names = ["doc_id", "did", "fp", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(3)):
                gone = batch.column(4).slice(part.lo, part.hi - part.lo).to_pylist()
                total, removed, spans, kept = [], [], [], []
                words = find_words(part) if enough else None
                for i, runs in enumerate(gone):
                    text = part.data[part.offsets[i]:part.offsets[i + 1]].tobytes()
                    lo, hi = (np.array([r[c] for r in runs or ()], np.int64) for c in ("s", "e"))
                    if enough:
                        own = slice(words.first[i], words.first[i + 1])
                        lo, hi = _enough(lo, hi, words.starts[own] - part.offsets[i], words.ends[own] - part.offsets[i],
                                         length, enough)
                    else:
                        lo, hi = merged(lo, hi)
                    edges = zip([0, *hi.tolist()], [*lo.tolist(), len(text)])
                    kept.append(b"".join([text[a:b] for a, b in edges]))
                    total.append(len(text))
                    removed.append(len(text) - len(kept[-1]))
                    spans.append(len(lo))
                rows = [batch.column(j).slice(part.lo, part.hi - part.lo) for j in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*rows, *(pa.array(c, pa.int64()) for c in (total, removed, spans)), pa.array(kept, pa.binary())],
                    names)

    return docs.select("doc_id", "did", "fp", "text", "gone").mapInArrow(
        giving_back(run), "doc_id long, did long, fp long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_bytes(docs: DataFrame, length: int = 400, enough: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, did, fp, n_bytes, n_removed, n_spans and kept (binary) of each row of (doc_id, text).

    Texts count as UTF-8 bytes; a null is empty. A byte goes if a string of ``length`` bytes (4 at least)
    that covers it also starts anywhere else, in this text or another, overlaps included; all strings are
    judged on the input. n_spans counts the maximal removed runs. A row that stands twice is two
    texts, so both lose what they share. Shorter texts lose nothing. did and fp identify the row as ``identified``
    does. Other columns are left out.

    ``enough`` (bytes, words) keeps all but the passages of at least so many bytes or whole words, words being
    runs without white space; a passage is one in which a repeated string starts at each byte up to its last ``length``.
    """
    docs = identified(docs)
    gone = _repeats(docs, length)
    some, others = maybe_among(docs, gone, ["did", "fp"])
    whole = others.withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    return _cut(some.join(gone, ["did", "fp"], "left").unionByName(whole), length, enough)


def shortened(docs: DataFrame, length: int, enough: tuple[int, int] | None = None) -> DataFrame:
    """did, fp and kept of the texts that lose something by ``repeated_bytes``, each once; the others are not shuffled."""
    docs = identified(docs)
    gone = _repeats(docs, length)
    some = maybe_among(docs, gone, ["did", "fp"])[0].join(gone, ["did", "fp"]).dropDuplicates(["did", "fp"])
    return _cut(some, length, enough).where("n_removed > 0").select("did", "fp", "kept")


def _repeats(docs: DataFrame, length: int) -> DataFrame:
    """(did, fp, gone): the runs s..e of bytes in repeated strings, of the texts that have any."""
    suffixes = cut_lineage(_suffix_rows(docs, length, _often(docs, length)))
    distinct = suffixes.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.first("before").alias("before"), F.first("after").alias("after"))
    distinct = cut_lineage(distinct)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _bucket(pa.Table.from_batches(rows), length)

    lead = F.substring("after", 1, _split(length)[0])
    many = cut_lineage(distinct.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > HOT).select("lead", F.lit(True).alias("hot")))
    dealt = beside(distinct.withColumn("lead", lead), many, "lead").withColumn("hot", F.coalesce("hot", F.lit(False)))
    deeper = [F.when(F.col("hot"), F.col(c)) for c in ("after", "before")]
    sorted_runs = cut_lineage(
        dealt.repartitionByRange(parts, "lead", *deeper).select("id", "lo", "hi", "before", "after", "hot")
        .mapInArrow(giving_back(run), "id binary, lo int, hi int, window binary"))
    outer = sorted_runs.where("window is not null")
    across = outer.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    flagged = (distinct.where("n > 1").select("id", "lo", "hi")
               .union(sorted_runs.where("window is null").select("id", "lo", "hi"))
               .union(outer.where("id is not null").join(across, "window", "left_semi").select("id", "lo", "hi")))
    gone = suffixes.select("did", "fp", "at", "id").join(flagged, "id").groupBy("did", "fp").agg(
        F.collect_set(F.struct((F.col("at") - F.col("hi")).alias("s"),
                               (F.col("at") - F.col("lo") + length).alias("e"))).alias("gone"))
    return cut_lineage(gone)


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the remaining bytes."""
    return repeated_bytes(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                               F.sha2("kept", 256).alias("kept_sha256"))
