"""Texts of an Arrow batch as byte arrays, and polynomial hashes over them.

A hash here is a polynomial in an odd base modulo 2**64. Prefix sums of (symbol x power) give the
hash of any run of symbols from two entries, so all windows of a text cost one pass in numpy.
The working memory is some forty times a chunk; a chunk is about ``CHUNK`` bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
SYMBOLS = [np.random.default_rng(seed).integers(1, 2**64, 256, dtype=U) for seed in (11, 29)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)            # words are runs of bytes other than white space
SPACED[[0x20, *range(0x09, 0x0E)]] = False

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK)
        inverse = U(pow(int(base), -1, 2**64))
        def run(b):
            out = np.full(size, b, U)
            out[0] = 1
            return np.multiply.accumulate(out)
        have = run(base), run(inverse)
        if n <= 2 * CHUNK:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


class Poly:
    """Hashes of runs of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self.down = powers(BASES[which], len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of ``size`` symbols, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, but at the end of a task Arrow returns the memory that it holds unused.

    Workers outlive their tasks, and those of the next step share their executor's memory.
    """
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return task


@dataclass
class Chunk:
    """Rows lo..hi of a batch; text i is data[offsets[i]:offsets[i + 1]]."""
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, raw = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """The words of a chunk in order; text i has words first[i]..first[i + 1]."""
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def find_words(chunk: Chunk, is_word: np.ndarray = SPACED) -> Words:
    inside = is_word[chunk.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, chunk.offsets))


def word_hashes(chunk: Chunk, words: Words, fold: bool = False, which: int = 0) -> np.ndarray:
    data = LOWER[chunk.data] if fold else chunk.data
    return Poly(SYMBOLS[which][data], which).runs(words.starts, words.ends)


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least value of every ``size`` neighbors, by doubling."""
    out, span = x, 1
    while span < size:
        step = min(span, size - span)
        out = np.minimum(out[:len(out) - step], out[step:])
        span += step
    return out


def anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): the windows of ``span`` neighbors that start at first..last have their least value at ``at``.

    Ties go to the leftmost, so equal windows have their anchor at the same place inside them. A
    value's low bits make room for its position; texts are shorter than 2**31.
    """
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = U(31)
    least = window_min((grams >> low) << low | np.arange(len(grams), dtype=U), span)
    at = (least & U(2**31 - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], first, np.append(first[1:], len(at)) - 1


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open intervals; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(new[1:], True) if len(new) else new
    return starts[new], ends[last]
