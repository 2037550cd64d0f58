"""Token ids in binary blocks, by an adaptive context-mixing range coder.

The ids of all texts, in order of doc_id, are cut into blocks of ``BLOCK`` ids. Each block starts from an
empty model, so it can be read alone, and carries a checksum. Per id the model mixes three predictions
into one distribution: the id last seen after the two before it (order 2), the id last seen after the one before
it (order 1), each weighted by how often such a prediction has held at its present confidence, and
for the rest the frequencies of four 4-bit digits (order 0). A range coder codes the id by it.

A query's blocks are coded by BlockCoder.java, one after another; ``pack`` and ``unpack`` are the same in numpy, many side by side, for
use without Spark: one step codes one id of each, and both give the same bytes. Java finds the ids too, but for texts with
uncommon letters or special strings. A file is a table of blocks beside the (doc_id, n_tokens) of the texts that start in them.
"""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigscreen.llm.encode import BLOCK as TEXT_BYTES
from sigscreen.llm.encode import encoder
from sigscreen.llm.texts import chunks, giving_back
from sigscreen.llm.tokenizer import COMMON, Tokenizer, _classes, cached, read_file
from sigscreen.runtime import cut_lineage

BLOCK = 2048               # ids in a block
LANES = 1024               # blocks that pack and unpack take side by side, and at most in a batch that is written
ROWS = 2000                # texts cut into blocks at a time
MAGIC = b"TIB1"
SLOTS = 1 << 13            # contexts of a block's order-1 and order-2 tables
LEVELS = 8                 # confidences of a prediction
TOTAL = 16                 # log2 of a distribution's total
MASK = np.uint64(2**48 - 1)
TOP, BOTTOM = np.uint64(1 << 32), np.uint64(1 << 24)
S16 = np.uint64(16)


class Model:
    """The state of one block per lane; all arrays are indexed by lane first."""

    def __init__(self, lanes: int):
        self.row = np.arange(lanes)
        self.guess = np.zeros((2, lanes, SLOTS), np.uint16)
        self.sure = np.zeros((2, lanes, SLOTS), np.uint8)
        self.held = np.ones((2, lanes, LEVELS), np.int64)          # predictions that held
        self.tried = np.full((2, lanes, LEVELS), 2, np.int64)
        self.digits = np.full((lanes, 1 + 16 + 256 + 4096, 16), 8, np.uint16)
        self.last = np.zeros((2, lanes), np.int64)

    def mix(self):
        """The two guesses and the share of each, in 1 / 2**16."""
        one, two = self.last
        self.slot = ((one * 40503 + 7) % SLOTS, ((one * 40503 + two * 30011 + 11) % SLOTS))
        guess, share = [], []
        for k in (0, 1):
            at = (self.row, self.slot[k])
            guess.append(self.guess[k][at].astype(np.int64))
            level = self.sure[k][at]
            share.append(self.held[k][self.row, level] * 60000 // self.tried[k][self.row, level])
        two = np.maximum(share[1], 1)
        one = np.maximum(share[0] * (65536 - two) // 65536, 1)
        return guess[1], guess[0], two, one

    def learn(self, ids: np.ndarray) -> None:
        for k in (0, 1):
            at = (self.row, self.slot[k])
            level = self.sure[k][at]
            right = self.guess[k][at] == ids
            self.held[k][self.row, level] += right
            tried = self.tried[k][self.row, level] + 1
            self.tried[k][self.row, level] = tried
            old = tried > 400
            if old.any():
                self.held[k][self.row[old], level[old]] //= 2
                self.tried[k][self.row[old], level[old]] = 200
            self.sure[k][at] = np.where(right, np.minimum(level + 1, LEVELS - 1), level // 2)
            self.guess[k][at] = np.where(right | (level > 3), self.guess[k][at], ids)
        self.last[1] = self.last[0]
        self.last[0] = ids

    def digit(self, lane: np.ndarray, context: np.ndarray):
        """Cumulative frequencies of the next digit, scaled to 2**16."""
        ends = np.cumsum(self.digits[lane, context], axis=1, dtype=np.float64)
        ends = (ends * (65536 / ends[:, -1:])).astype(np.int32)
        ends[:, -1] = 65536
        return ends

    def count(self, lane: np.ndarray, context: np.ndarray, digit: np.ndarray) -> None:
        row = self.digits[lane, context]
        row[np.arange(len(lane)), digit] += 24
        full = row.sum(axis=1, dtype=np.int32) > 8000
        if full.any():
            row[full] = row[full] // 2 + 1
        self.digits[lane, context] = row


# where the digits of an id begin, by how many have been read
BASE = (0, 1, 17, 273)


def pack(blocks: list[np.ndarray]) -> list[bytes]:
    """Code up to ``LANES`` blocks of ids below 2**16."""
    lanes = len(blocks)
    size = np.array([len(b) for b in blocks])
    ids = np.zeros((lanes, int(size.max(initial=0))), np.int64)
    for i, b in enumerate(blocks):
        ids[i, :len(b)] = b
    model = Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, MASK)
    out = np.zeros((lanes, 64 + 6 * ids.shape[1]), np.uint16)
    used = np.zeros(lanes, np.int64)

    def put(lane, start, width):
        step = span[lane] >> S16
        a = (low[lane] + step * start.astype(np.uint64)) & MASK
        r = step * width.astype(np.uint64)
        # a carryless coder: a leading word that can no longer change leaves; a span too small is cut short
        while True:
            same = (a ^ (a + r)) < TOP
            small = ~same & (r < BOTTOM)
            r = np.where(small, (np.uint64(0) - a) & (BOTTOM - np.uint64(1)), r)
            move = same | small
            if not move.any():
                break
            to = lane[move]
            out[to, used[to]] = (a[move] >> np.uint64(32)).astype(np.uint16)
            used[to] += 1
            a = np.where(move, (a << S16) & MASK, a)
            r = np.where(move, r << S16, r)
        low[lane], span[lane] = a, r

    every = np.arange(lanes)
    for t in range(ids.shape[1]):
        x = ids[:, t]
        on = t < size
        c2, c1, w2, w1 = model.mix()
        is2 = x == c2
        is1 = ~is2 & (x == c1)
        start = np.where(is2, 0, np.where(is1, w2, w2 + w1))
        width = np.where(is2, w2, np.where(is1, w1, 65536 - w2 - w1))
        put(every[on], start[on], width[on])
        lane = every[on & ~is2 & ~is1]
        if len(lane):
            prefix = np.zeros(len(lane), np.int64)
            for k in range(4):
                context = BASE[k] + prefix
                digit = x[lane] >> (12 - 4 * k) & 15
                ends = model.digit(lane, context)
                hi = ends[np.arange(len(lane)), digit]
                lo = np.where(digit > 0, ends[np.arange(len(lane)), digit - 1], 0)
                put(lane, lo, hi - lo)
                model.count(lane, context, digit)
                prefix = prefix * 16 + digit
        model.learn(x)
    for _ in range(3):
        out[every, used] = (low >> np.uint64(32)).astype(np.uint16)
        used += 1
        low = (low << S16) & MASK
    return [MAGIC + len(b).to_bytes(4, "little") + zlib.crc32(b.astype("<u4").tobytes()).to_bytes(4, "little")
            + out[i, :used[i]].tobytes() for i, b in enumerate(blocks)]


def unpack(raw: list[bytes]) -> list[np.ndarray]:
    """The ids of up to ``LANES`` blocks; a damaged one raises ValueError."""
    lanes = len(raw)
    if any(r[:4] != MAGIC for r in raw):
        raise ValueError("not a block of token ids")
    size = np.array([int.from_bytes(r[4:8], "little") for r in raw])
    words = np.zeros((lanes, max((len(r) - 12) // 2 for r in raw) + 8), np.uint64)
    for i, r in enumerate(raw):
        words[i, :(len(r) - 12) // 2] = np.frombuffer(r, "<u2", offset=12)
    ids = np.zeros((lanes, int(size.max(initial=0))), np.int64)
    model = Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, MASK)
    code = words[:, 0] << np.uint64(32) | words[:, 1] << S16 | words[:, 2]
    used = np.full(lanes, 3)

    def peek(lane):
        step = span[lane] >> S16
        return np.minimum((((code[lane] - low[lane]) & MASK) // step).astype(np.int64), 65535)

    def take(lane, start, width):
        step = span[lane] >> S16
        a = (low[lane] + step * start.astype(np.uint64)) & MASK
        r = step * width.astype(np.uint64)
        c = code[lane]
        while True:
            same = (a ^ (a + r)) < TOP
            small = ~same & (r < BOTTOM)
            r = np.where(small, (np.uint64(0) - a) & (BOTTOM - np.uint64(1)), r)
            move = same | small
            if not move.any():
                break
            of = lane[move]
            c[move] = ((c[move] << S16) | words[of, np.minimum(used[of], words.shape[1] - 1)]) & MASK
            used[of] += 1
            a = np.where(move, (a << S16) & MASK, a)
            r = np.where(move, r << S16, r)
        low[lane], span[lane], code[lane] = a, r, c

    every = np.arange(lanes)
    for t in range(ids.shape[1]):
        on = t < size
        c2, c1, w2, w1 = model.mix()
        at = np.zeros(lanes, np.int64)
        at[on] = peek(every[on])
        is2 = at < w2
        is1 = ~is2 & (at < w2 + w1)
        start = np.where(is2, 0, np.where(is1, w2, w2 + w1))
        width = np.where(is2, w2, np.where(is1, w1, 65536 - w2 - w1))
        take(every[on], start[on], width[on])
        x = np.where(is2, c2, c1)
        lane = every[on & ~is2 & ~is1]
        if len(lane):
            prefix = np.zeros(len(lane), np.int64)
            for k in range(4):
                context = BASE[k] + prefix
                ends = model.digit(lane, context)
                digit = (ends <= peek(lane)[:, None]).sum(axis=1)
                hi = ends[np.arange(len(lane)), digit]
                lo = np.where(digit > 0, ends[np.arange(len(lane)), digit - 1], 0)
                take(lane, lo, hi - lo)
                model.count(lane, context, digit)
                prefix = prefix * 16 + digit
            x[lane] = prefix
        x = np.where(on, x, 0)
        ids[:, t] = x
        model.learn(x)
    out = []
    for i, r in enumerate(raw):
        own = ids[i, :size[i]]
        if zlib.crc32(own.astype("<u4").tobytes()) != int.from_bytes(r[8:12], "little"):
            raise ValueError("a block of token ids is damaged")
        out.append(own)
    return out


FILE = "part int, block int, data binary, doc_ids array<long>, sizes array<long>"
FILE_NAMES = ["part", "block", "data", "doc_ids", "sizes"]


def coder(spark: SparkSession, name: str, table: bytes | None = None) -> Callable[[Column], Column]:
    """A function of BlockCoder.java on columns, compiled by the compiler that Spark has for its own plans."""
    sc = spark.sparkContext
    jvm = sc._jvm
    if sc not in _LOADERS:
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "BlockCoder.java"), encoding="utf-8") as f:
            source = f.read()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        classes = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(prefix="sigscreen-coder-"), "sigscreen-coder.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for n in list(classes):
                out.writestr(n.replace(".", "/") + ".class", bytes(classes[n]))
        sc._jsc.addJar(jar)
        _LOADERS[sc] = compiler.getClassLoader()
    function = _LOADERS[sc].loadClass(f"sigscreen.{name}").getConstructors()[0].newInstance(sc._gateway.new_array(jvm.Object, 0))
    if table is not None:
        function.load(table)
    known = f"sigscreen_{name}_{zlib.crc32(table or b'')}"
    spark._jsparkSession.udf().register(known, function, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return lambda column: F.call_udf(known, column)


_LOADERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def word_table(tok: Tokenizer, end_id: int) -> bytes | None:
    """What EncodeText needs of a tokenizer; None for a kind of file that it does not know.

    It splits texts of common letters into lower-case words. A letter whose lower case is not one common letter is for Python,
    as are texts with a special string.
    """
    if not tok.lowers or max(*tok.names, end_id) >= 1 << 16 or not all("<|" in s for s in tok.special):
        return None
    classes = _classes()
    kind = np.full(COMMON, 3)
    for k, name in enumerate("SLN"):
        kind[[int(h, 16) for h in classes[name].split("\\u")[1:]]] = k
    lower = [chr(i).lower() for i in range(COMMON)]
    merges = [(a, b, rank, new) for (a, b), (rank, new) in tok.merges.items()]
    return np.array([COMMON, end_id, *tok.first, *tok.last, *(ord(c) if len(c) == 1 and ord(c) < COMMON else -1 for c in lower),
                     *kind, len(merges), *(x for m in merges for x in m)], "<i4").tobytes()


def write_blocks(docs: DataFrame, path: str, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """The file of the rows of (doc_id, text): ids by the tokenizer file at ``path``, ``end_id`` after each text.

    Rows are in ascending doc_id (null first, ties by text) over ``parts`` range partitions; each part numbers its blocks from 0. A
    null or empty text is its end id alone. Other columns are left out. Returns the table as read back.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(read_file(path))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn(
        "part", F.spark_partition_id())
    words = word_table(cached(file.value, Tokenizer), end_id)
    ids = coder(spark, "EncodeText", words)("text") if words else F.lit(None).cast("binary")
    # texts whose ids are still to be found go along, the others do not
    ordered = ordered.select("doc_id", "part", "text", ids.alias("ids")).select(
        "doc_id", "part", "ids", F.when(F.col("ids").isNull(), F.col("text")).alias("text"))

    def run(batches):
        held = np.zeros(0, np.uint32)           # ids not yet in a block
        starts: list[tuple[int, int, int]] = []     # (position in the part, doc_id, ids) of texts not yet in a block
        at, block, part = 0, 0, 0               # position of held[0]

        def blocks(n):
            nonlocal held, starts, at, block
            size = min(n * BLOCK, len(held))
            own: list[list] = [[] for _ in range(n)]
            rest = []
            for s in starts:
                k = (s[0] - at) // BLOCK
                (own[k] if k < n else rest).append(s)
            cuts = np.minimum(np.arange(n + 1) * BLOCK, size).astype("<i4") * 4
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(held[:size].astype("<u4"))])
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(block, block + n), pa.int32()), raw,
                 pa.array([[s[1] for s in o] for o in own], pa.list_(pa.int64())),
                 pa.array([[s[2] for s in o] for o in own], pa.list_(pa.int64()))], FILE_NAMES)
            starts, at, block = rest, at + size, block + n
            held = held[size:]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1)[0].as_py()
            for lo in range(0, batch.num_rows, ROWS):
                piece = batch.slice(lo, ROWS)
                flat, sizes = _ids(piece, file, end_id)
                base = at + len(held)
                starts += zip((base + np.cumsum(sizes) - sizes).tolist(), piece.column(0).to_pylist(), sizes.tolist())
                held = np.concatenate([held, flat])
                while len(held) >= BLOCK:
                    yield blocks(min(LANES, len(held) // BLOCK))
        if len(held):
            yield blocks(1)

    cut = ordered.mapInArrow(giving_back(run), FILE.replace("data", "ids"))
    return cut_lineage(cut.select("part", "block", coder(spark, "PackBlock")("ids").alias("data"), "doc_ids", "sizes"))


def _ids(rows: pa.RecordBatch, file, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows in one array, and the number of ids per row; those of rows without are found here."""
    col = rows.column(2)
    _, places, raw = col.buffers()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(places, kind)[col.offset:col.offset + len(col) + 1] // 2
    flat = np.frombuffer(raw, "<u2", ends[-1]) if raw is not None and ends[-1] else np.zeros(0, "<u2")
    if not col.null_count:
        return flat[ends[0]:].astype(np.uint32), np.diff(ends).astype(np.int64)
    enc = encoder(file.value)
    lone = np.flatnonzero(col.is_null().to_numpy(zero_copy_only=False))
    texts = rows.column(3).take(pa.array(lone))
    found: list[np.ndarray] = []
    for piece in chunks(texts, TEXT_BYTES):
        more, cuts, _ = enc.texts([t or "" for t in texts.slice(piece.lo, piece.hi - piece.lo).to_pylist()])
        found += [np.append(more[a:b], end_id) for a, b in zip(cuts[:-1], cuts[1:])]
    sizes = np.diff(ends).astype(np.int64)
    sizes[lone] = [len(f) for f in found]
    out, at = [], 0
    for i, f in zip(lone.tolist(), found):
        out += [flat[ends[at]:ends[i]], f]
        at = i + 1
    return np.concatenate([*out, flat[ends[at]:]]).astype(np.uint32), sizes


def read_blocks(file: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each text of a file, from its decoded blocks."""
    names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]

    def run(batches):
        now = None
        texts: deque[tuple[int, int]] = deque()     # (doc_id, ids) of the texts whose ids are still to come
        crc = have = at = 0                     # of the text being read, and the position of its start
        for batch in batches:
            parts = batch.column(0).to_numpy()
            ids, docs, sizes = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for part, own, d, s in zip(parts.tolist(), ids, docs, sizes):
                if part != now:
                    now, crc, have, at = part, 0, 0, 0
                    texts.clear()
                texts += zip(d, s)
                lo, raw = 0, memoryview(own)
                while texts:
                    doc, n = texts[0]
                    use = min(4 * (n - have), len(raw) - lo)
                    crc = zlib.crc32(raw[lo:lo + use], crc)
                    lo, have = lo + use, have + use // 4
                    if have < n:
                        break
                    out.append((part, doc, at, n, crc))
                    at, crc, have = at + n, 0, 0
                    texts.popleft()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.int64()] * 4))], names)

    ordered = file.repartition("part").sortWithinPartitions("part", "block")
    rows = ordered.select("part", coder(file.sparkSession, "UnpackBlock")("data").alias("ids"), "doc_ids", "sizes").mapInArrow(
        giving_back(run), "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    rows = cut_lineage(rows)
    # where each part begins; a row per part
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(totals.select("part", before.alias("before"))), "part").select(
        "doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the written and decoded file.

    start counts the ids of all documents before, n_tokens those of the document with its end id; a row
    that stands twice is two documents. See ``write_blocks``.
    """
    return read_blocks(write_blocks(docs, path))
