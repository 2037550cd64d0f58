"""Alignment of two tokenizers' tokens over the bytes of a text, and how often their ids meet in a corpus.

Side A is a byte-level file of the tokenizers library, side B a sentencepiece model that puts a space before a text; A gets that
space too, so both sides cover the same bytes. Per batch, two backward as-of merges keyed by document find for each token start
the token of the other side that covers it; both directions together are all overlaps. Places where both sides end cut groups.

Texts are tokenized in blocks of some ``BLOCK`` bytes. A block keeps its distinct id pairs once, so what is shuffled are a block's
distinct pairs, never links of documents, and no pair has more than a row per block however common it is.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.corpus import by_key
from sigscreen.llm.texts import chunks
from sigscreen.llm.tokenizer import byte_letters, cached, read_file
from sigscreen.runtime import cut_lineage

BLOCK = 2 << 20            # bytes of text in a block, about; a longer text is a block of its own
KNOWN = 96 << 20           # bytes of pieces that a task remembers, their tables counted in; past this it starts anew
PIECE = 280                # bytes that a piece takes beside its own characters
SOME = 20_000              # pieces encoded in one call
SPACE = "▁"


class Table:
    """Ids of known pieces of text on one side, in one array."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], names: list[bytes], joined: bool):
        self.encode, self.names, self.joined = encode, names, joined       # joined: new pieces go through as one text, which is faster
        self.sizes = np.array([len(n) for n in names])
        self.forget()

    def forget(self) -> None:
        self.ids, self.start, self.size = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Which of the new pieces have tokens of just a space and their own bytes."""
        found = self.together(pieces) or self.one_by_one(pieces)
        ids, size, good = found
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        return good

    def together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The ids of pieces joined by spaces, their number per piece, and True each; None if some piece or token does not fit."""
        if not self.joined or any(p[0].isspace() or p[-1].isspace() for p in pieces):
            return None
        whole = " ".join(pieces)
        ids = self.encode([whole])[0]
        if b"".join(map(self.names.__getitem__, ids)) != b" " + whole.encode():
            return None
        ids = np.array(ids, np.int64)
        ends = np.cumsum(self.sizes[ids])
        own = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, own)
        if not np.array_equal(ends[last], own):
            return None
        return ids, np.diff(last, prepend=-1), np.ones(len(pieces), bool)

    def one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.encode(pieces)
        size = np.fromiter(map(len, found), np.int64, len(found))
        good = [b"".join(map(self.names.__getitem__, ids)) == b" " + p.encode() for p, ids in zip(pieces, found)]
        return np.fromiter(chain.from_iterable(found), np.int64, int(size.sum())), size, np.array(good, bool)

    def tokens(self, at: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces ``at`` in turn, and their number per text."""
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]
        return flat, np.bincount(text, size, texts).astype(np.int64)


class Sides:
    """Both tokenizers, built on each worker from the contents of their files.

    A text is encoded piece by piece, cut at single spaces between other than white space: there neither side has a token that goes on.
    A piece is encoded once while the table of known pieces, bounded in bytes, lasts.
    """

    def __init__(self, files: tuple[str, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(files[0])
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        names = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
        bytes_a = [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode()
                   for t in (names.get(i, "") for i in range(max(names) + 1))]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # without a token that goes on past a space, what stands before a space has no part in what follows
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.odd = re.compile(r"\s\s|\A\s|\s\Z").search
        self.lone = re.compile(r"(?<=\S) (?=\S)").split
        self.a = Table(lambda own: [e.ids for e in a.encode_batch_fast([" " + p for p in own], add_special_tokens=False)], bytes_a, self.apart)
        self.b = Table(lambda own: b.encode(own, num_threads=1), bytes_b, False)
        self.shown = [np.array([f"{i}{mark}" for i in range(len(table))], object)
                      for table, marks in ((bytes_a, ",|"), (bytes_b, ",;")) for mark in marks]
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.a.forget()
        self.b.forget()

    def split(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        return self.lone(text) if self.odd(text) else text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if not (p[0].isspace() or p[-1].isspace())]
        edged = [p for p in pieces if p[0].isspace() or p[-1].isspace()]
        groups = [x[lo:lo + SOME] for x in (plain, edged) for lo in range(0, len(x), SOME)]
        for some in groups:                            # the library's results are large
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            self.held += sum(map(len, some)) + PIECE * len(some)
            self.good = np.concatenate([self.good, self.a.learn(some) & self.b.learn(some)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of side A of all texts in one array and their number per text; the same of side B.

        A text has none if either side's bytes are not a space and the text.
        """
        if self.held > KNOWN:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        pieces = list(chain.from_iterable(split))
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = [pieces[i] for i in new.tolist()]
            self.learn(list(dict.fromkeys(unknown)))
            at[new] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(new))
        bad = np.bincount(text, ~self.good[at], len(texts)) > 0
        if bad.any():
            at, text = at[~bad[text]], text[~bad[text]]
        return (*self.a.tokens(at, text, len(texts)), *self.b.tokens(at, text, len(texts)))


def read_files(path_a: str, path_b: str) -> tuple[str, bytes]:
    with open(path_b, "rb") as f:
        return read_file(path_a), f.read()


class Aligned:
    """The tokens of some texts, side by side."""

    def __init__(self, sides: Sides, texts: list[str]):
        self.a, self.n_a, self.b, self.n_b = sides.encode(texts)
        doc = np.arange(len(texts))
        size_a, size_b = sides.a.sizes[self.a], sides.b.sizes[self.b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)           # both sides of a text have as many bytes
        left = pd.DataFrame({"start": end_a - size_a, "doc": np.repeat(doc, self.n_a), "a": np.arange(len(self.a))})
        right = pd.DataFrame({"start": end_b - size_b, "doc": np.repeat(doc, self.n_b), "b": np.arange(len(self.b))})
        covering_b = pd.merge_asof(left, right, on="start", by="doc")["b"].to_numpy(np.int64)
        covering_a = pd.merge_asof(right, left, on="start", by="doc")["a"].to_numpy(np.int64)
        inside = left["start"].to_numpy()[covering_a] < right["start"].to_numpy()      # equal starts were found already
        self.link_a = np.concatenate([left["a"].to_numpy(), covering_a[inside]])
        self.link_b = np.concatenate([covering_b, right["b"].to_numpy()[inside]])
        self.doc = np.concatenate([left["doc"].to_numpy(), right["doc"].to_numpy()[inside]])
        self.n_links = np.bincount(self.doc, minlength=len(texts))
        self.last_a, self.last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.group_b = np.cumsum(self.last_b) - self.last_b
        self.n_groups = np.bincount(left["doc"].to_numpy()[self.last_a], minlength=len(texts))
        self.sides = sides

    def groups(self) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        begin_b = np.append(0, np.flatnonzero(self.last_b) + 1)
        end_a = np.flatnonzero(self.last_a) + 1
        out = np.empty(len(self.a) + len(self.b), object)
        within, closing, within_b, closing_b = self.sides.shown
        for place, ids, last, mid, end in (
                (np.arange(len(self.a)) + begin_b[self.group_a], self.a, self.last_a, within, closing),
                (np.arange(len(self.b)) + end_a[self.group_b], self.b, self.last_b, within_b, closing_b)):
            out[place] = mid[ids]
            out[place[last]] = end[ids[last]]
        cuts = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield "".join(out[lo:hi].tolist())[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs as a << 32 | b; then by text and pair: the pair's place among them, how often, and their number per text."""
        codes, place = np.unique(self.a[self.link_a] << 32 | self.b[self.link_b], return_inverse=True)
        wide = max(len(codes), 1)
        held, times = np.unique(self.doc * wide + place, return_counts=True)
        return codes, held % wide, times, np.bincount(held // wide, minlength=len(self.n_a))


def _blocks(docs: DataFrame, files, schema: str, make) -> DataFrame:
    """``make`` of each block's number, ids and Aligned texts, as record batches."""
    def run(batches):
        sides = cached(files.value, Sides)
        number = TaskContext.get().partitionId() << 32
        try:
            for batch in batches:
                col = batch.column(1)
                for part in chunks(col, BLOCK):
                    size = part.hi - part.lo
                    yield make(number, batch.column(0).slice(part.lo, size), Aligned(sides, col.slice(part.lo, size).to_pylist()))
                    number += 1
        finally:
            sides.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of (doc_id, text): ids_a and ids_b, the group number of each of them, and link_a and link_b, the places in them
    of tokens that overlap.

    Both sides cover a space and the text. A text that is null or empty, or whose tokens' bytes on either side are not just that, has
    no tokens. Special tokens' strings inside texts are plain text. Repeated rows and null ids give a row each. Other columns are left out.
    """
    files = docs.sparkSession.sparkContext.broadcast(read_files(path_a, path_b))
    names = ["doc_id", "ids_a", "ids_b", "group_a", "group_b", "link_a", "link_b"]

    def make(number, ids, found: Aligned) -> pa.RecordBatch:
        order = np.lexsort((found.link_b, found.link_a))
        first_a, first_b, first_g = (np.cumsum(n) - n for n in (found.n_a, found.n_b, found.n_groups))
        doc = found.doc[order]
        return pa.RecordBatch.from_arrays(
            [ids, _lists(found.a, found.n_a), _lists(found.b, found.n_b),
             _lists(found.group_a - np.repeat(first_g, found.n_a), found.n_a), _lists(found.group_b - np.repeat(first_g, found.n_b), found.n_b),
             _lists(found.link_a[order] - first_a[doc], found.n_links), _lists(found.link_b[order] - first_b[doc], found.n_links)], names)

    return _blocks(docs, files, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names[1:]), make)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, n and best: in how many documents of the blocks an id pair is linked, and whether no other pair of its A id has more."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.n").alias("n"))
    counts = cut_lineage(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))           # no more rows than side A has ids
    return counts.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row, as ``align`` treats it.

    An id pair's count is the number of rows of ``docs`` that hold it linked. n_best counts a row's links whose pair has the
    highest count of its A id, ties included; count_sum adds up the counts of its links.
    """
    files = docs.sparkSession.sparkContext.broadcast(read_files(path_a, path_b))

    def make(number, ids, found: Aligned) -> pa.RecordBatch:
        codes, place, times, sizes = found.pairs()
        shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
        kept = io.BytesIO()
        np.savez(kept, place=place.astype(np.int32), times=times.astype(np.int32), sizes=sizes.astype(np.int32))
        rows = pa.StructArray.from_arrays(
            [ids, *(pa.array(n.astype(np.int64)) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(shas)],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        one = [pa.array([number], pa.int64()), _one(pa.array(codes)),
               _one(pa.array(np.bincount(place, minlength=len(codes)))), _one(rows), pa.array([kept.getvalue()], pa.binary())]
        return pa.RecordBatch.from_arrays(one, ["block", "pairs", "n", "rows", "links"])

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
    rows = f"array<struct<{fields.replace(' long', ':long')},groups_sha256:string>>"
    blocks = cut_lineage(_blocks(docs, files, f"block long, pairs array<long>, n array<long>, rows {rows}, links binary", make))
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair")
    met = asked.select("block", "pos", "n", "best").unionByName(
        blocks.select("block", F.lit(-1).alias("pos"), "rows", "links"), allowMissingColumns=True)

    def run(batches):
        for group in by_key(batches, ["block"]):
            found = group.column("rows").slice(0, 1).combine_chunks().flatten()       # the block itself comes first
            with np.load(io.BytesIO(group.column("links")[0].as_py())) as got:
                place, times, sizes = (got[k] for k in ("place", "times", "sizes"))
            n, best = (group.column(c).slice(1).combine_chunks().to_numpy(zero_copy_only=False) for c in ("n", "best"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            if len(place):
                np.add.at(sums[0], doc, times * best[place].astype(bool))
                np.add.at(sums[1], doc, times * n[place].astype(np.int64))
            cols = {f.name: found.field(i) for i, f in enumerate(found.type)}
            yield pa.RecordBatch.from_arrays(
                [*(cols[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), cols["groups_sha256"]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return met.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(
        run, f"{fields}, n_best long, count_sum long, groups_sha256 string")


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
