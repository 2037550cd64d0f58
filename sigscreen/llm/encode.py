"""BPE encoding and decoding by an index of pair occurrences.

The distinct words of a block of text stand in one array of symbols. An index maps each adjacent pair that
can merge to its positions. The active ranks are applied in ascending order: all occurrences of a
pair merge at once, left to right, and the lists of the pairs beside them are updated. Words are
encoded once per task while the table of known words, bounded in bytes, lasts; it goes when the task ends.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.texts import chunks, giving_back
from sigscreen.llm.tokenizer import Tokenizer, cached, read_file

KNOWN = 96 << 20           # bytes of words that a task remembers, their tables counted in; past this it starts anew
WORD = 300                 # bytes that a word takes beside its own characters
BLOCK = 2 << 20            # bytes of text whose new words are merged together


class PairIndex:
    """Merges all words of one array of symbols."""

    def __init__(self, tok: Tokenizer):
        pairs = sorted((a << 32 | b, r, m) for (a, b), (r, m) in tok.merges.items())
        self.keys = np.array([p[0] for p in pairs] or [0], np.int64)
        self.ranks = np.array([p[1] for p in pairs] or [-1], np.int64)
        self.merged = {p[1]: (p[0] >> 32, p[0] & 0xFFFFFFFF, p[2]) for p in pairs}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the number of ids per word."""
        sizes = np.array([len(w) for w in words], np.int64)
        n = int(sizes.sum())
        # a wall of -1 after each word keeps pairs inside it
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(n) + word
        sym = np.full(n + len(words) + 1, -1, np.int64)
        sym[place] = np.fromiter((s for w in words for s in w), np.int64, n)
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        alive = sym >= 0

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions."""
            rank = self.rank_of(sym[at], sym[after[at]])
            use = rank >= 0
            if not use.any():
                return
            rank, at = rank[use], at[use]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        first = place[alive[place]]
        add(first[sym[first + 1] >= 0])
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.merged[r]
            nxt = after[at]
            ok = alive[at] & (sym[at] == a) & (sym[nxt] == b)
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:          # in a run of equal symbols take every other pair
                at.sort()
                nxt = after[at]
                new_run = np.append(True, at[1:] != nxt[:-1])
                begin = np.flatnonzero(new_run)
                even = (np.arange(len(at)) - begin[np.cumsum(new_run) - 1]) % 2 == 0
                at, nxt = at[even], nxt[even]
            if not len(at):
                continue
            sym[at] = new
            alive[nxt] = False
            sym[nxt] = -2
            beyond = after[nxt]
            after[at] = beyond
            before[beyond] = at
            prior = before[at]
            prior = prior[prior >= 0]
            add(np.unique(np.concatenate([at, prior[sym[prior] >= 0]])) if len(prior) else at)
        left = place[alive[place]]
        counts = np.bincount(word[alive[place]], minlength=len(words))
        return sym[left], counts


class Encoder:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, text: str):
        self.tok = Tokenizer(text)
        self.pairs = PairIndex(self.tok)
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.known: dict[str, int] = {}
        self.shown: list[str] = []               # each word's tokens joined by one space
        self.ids = np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, sizes = self.pairs.encode([self.tok.symbols(w) for w in words])
        base = len(self.known)
        self.held += sum(map(len, words)) + WORD * len(words)
        self.known.update(zip(words, range(base, base + len(words))))
        ends = np.cumsum(sizes)
        name = self.tok.names
        flat = ids.tolist()
        lo = 0
        for hi in ends.tolist():
            self.shown.append(" ".join([name[i] for i in flat[lo:hi]]))
            lo = hi
        self.start = np.concatenate([self.start, len(self.ids) + ends - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """The ids of all texts in one array, where each text starts in it, and the texts' words."""
        split = [self.tok.words(t) for t in texts]
        if self.held > KNOWN:
            self.forget()
        new = set().union(*split).difference(self.known) if split else ()
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        counts = np.array([len(w) for w in split], np.int64)
        at = np.fromiter((i for w in split for i in map(get, w)), np.int64, int(counts.sum()))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)]
        word_ends = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return flat, word_ends, split


def encoder(text: str) -> Encoder:
    return cached(text, Encoder)


def encode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and with ``decode`` the decoded text, of each row of (doc_id, text).

    The result is what the tokenizers library gives for the file at ``path`` without added special
    tokens, padding or truncation. A null or empty text has no ids and decodes to the empty text.
    Repeated rows and null ids give a row each. A file without a decoder joins its tokens by one
    space. Other columns are left out. Memory is that of a chunk of texts and the known words.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(read_file(path))
    schema = "doc_id long, ids array<int>" + (", decoded string" if decode else "")

    def run(batches):
        enc = encoder(file.value)
        enc.forget()
        try:
            for batch in batches:
                col = batch.column(1)
                for part in chunks(col, BLOCK):
                    texts = [t or "" for t in col.slice(part.lo, part.hi - part.lo).to_pylist()]
                    flat, ends, split = enc.texts(texts)
                    out = [batch.column(0).slice(part.lo, part.hi - part.lo),
                           pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                    pa.array(flat.astype(np.int32)))]
                    if decode:
                        known, shown = enc.known.__getitem__, enc.shown.__getitem__
                        out.append(pa.array([" ".join(map(shown, map(known, w))) for w in split],
                                            pa.string()))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][:len(out)])
        finally:
            enc.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(run), schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows (doc_id, ids), special tokens kept; null ids give the empty text.

    As in the files that declare no decoder, the tokens are joined by one space.
    """
    file = tokens.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches):
        tok = encoder(file.value).tok
        names = np.array([tok.names.get(i, "") for i in range(max(tok.names) + 1)], object)
        for batch in batches:
            texts = [" ".join(names[ids]) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return encode(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
