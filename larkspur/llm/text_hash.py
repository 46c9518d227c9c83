"""Words and their hashes, for whole batches of texts at once.

Texts stay the UTF-8 bytes of their Arrow column.  Words are runs of bytes other than
0x20 and 0x09-0x0D; a word's hash sums a random number for each byte times a power of
an odd number for its place, then mixes; hashes of word sequences build on those.  All
hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on at once; one text is never split.
SLICE = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * _ODD)


@lru_cache(1)
def _blank() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


@lru_cache(1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(8)
def _powers(n: int, base: int = int(_STEP)) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(6, int(n).bit_length()))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Words:
    """The words of some texts: byte ranges [start, end), first word of each text (bounds), hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _lower()[data] if lower else data
        word = ~_blank()[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = word[heads]
        self.start = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        size = self.end - self.start
        if len(size):
            at = np.arange(len(data))
            place = at - np.maximum.accumulate(np.where(first, at, 0))
            place[~word] = 0
            part = byte_values()[data] * powers(int(size.max()))[place]
            part[~word] = 0
            self.hash = mix(np.add.reduceat(part, self.start) + size.astype(U))
        else:
            self.hash = np.zeros(0, U)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k hashes: one for each start, len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, U)
    total, done, at = None, 0, 0
    block, width = h, 1  # block: hashes of runs of width
    rest = k
    while rest:
        if rest & 1:
            part = block[at:]
            if total is None:
                total = part.copy()
            else:
                n = min(len(total), len(part))
                total = total[:n] * _STEP + part[:n] * U(2 * done + 3)
            at += width
            done += width
        rest >>= 1
        if rest:
            block = block[:-width] * (_ODD + U(2 * width)) + mix(block[width:])
            width *= 2
    return mix(total[: len(h) - k + 1])


def doc_ngrams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the k-word runs of each text, in order; text i has hashes[bounds[i]:bounds[i + 1]]."""
    counts = np.maximum(np.diff(words.bounds) - (k - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    grams = ngrams(words.hash, k)
    at = np.repeat(words.bounds[:-1] - bounds[:-1], counts) + np.arange(int(bounds[-1]))
    return grams[at], bounds
