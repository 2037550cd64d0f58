"""Token counts by byte-pair merging on a heap and a linked list, without making ids."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscreen.llm.texts import chunks
from sigscreen.llm.tokenizer import Tokenizer, cached, read_file

KNOWN = 64 << 20            # bytes of words whose counts a task remembers, their tables counted in; past this it starts anew
WORD = 150                  # bytes that a word takes beside its own characters


def count_merged(symbols: list[int], merges: dict) -> int:
    """The number of symbols left: each round pops the lowest-ranked adjacent pair, leftmost first.

    A heap entry is rank and position in one number; one whose pair has changed since is passed over.
    """
    n = len(symbols)
    get = merges.get
    heap = []
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        found = get(pair)
        if found:
            heap.append(found[0] << 32 | i)
    if not heap:
        return n
    heapify(heap)
    sym = list(symbols)
    sym.append(-1)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    left = n
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        j = after[i]
        found = get((sym[i], sym[j]))
        if found is None or found[0] != entry >> 32:
            continue
        new = sym[i] = found[1]
        sym[j] = -2
        left -= 1
        k = after[i] = after[j]
        before[k] = i
        found = get((new, sym[k]))
        if found:
            heappush(heap, found[0] << 32 | i)
        h = before[i]
        if h >= 0:
            found = get((sym[h], new))
            if found:
                heappush(heap, found[0] << 32 | h)
    return left


class Counts(dict):
    """Word to number of tokens, worked out when first asked for."""

    def __init__(self, text: str):
        super().__init__()
        self.tok = Tokenizer(text)
        self.held = 0

    def __missing__(self, word: str) -> int:
        self.held += len(word) + WORD
        n = self[word] = count_merged(self.tok.symbols(word), self.tok.merges)
        return n

    def forget(self) -> None:
        self.clear()
        self.held = 0


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of (doc_id, text).

    Counts are those of the tokenizers library for the file at ``path``; a special string inside a
    text is one token. A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids
    give a row each. Other columns are left out.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches):
        counts: Counts = cached(file.value, Counts)
        words = counts.tok.words
        for batch in batches:
            col = batch.column(1)
            for part in chunks(col):
                if counts.held > KNOWN:
                    counts.forget()
                get = counts.__getitem__
                n = [sum(map(get, words(t))) if t else 0
                     for t in col.slice(part.lo, part.hi - part.lo).to_pylist()]
                sizes = part.offsets[1:] - part.offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(sizes),
                     pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
