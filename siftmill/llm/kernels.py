"""Small numpy helpers over the UTF-8 buffer of an Arrow text column.

Every helper works on one chunk of whole documents (about a megabyte of text), so a Python worker holds a few dozen
megabytes whatever the size of the table or of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Bytes 0x20 and 0x09-0x0D separate words; every other byte belongs to one.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Only A-Z are folded: the table contracts name these letters alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            made.append(np.cumprod(step))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts) of runs of whole documents with about `limit` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 20_000)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tokens(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; words do not cross documents."""
    word = is_word[data]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = starts[:-1] < starts[1:]
    before[starts[:-1][full]] = False
    after[starts[1:][full] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(starts, start, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte ranges, from the sums of `prefix_hash`."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix64(raw ^ ((end - start).astype(np.uint64) << np.uint64(52)))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each A-Z-folded word, and the number of words before each document's first (one more at the end)."""
    folded = LOWER[data]
    start, end, _ = tokens(folded, starts)
    first = np.searchsorted(start, starts)
    return span_hash(prefix_hash(folded), start, end), first


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingles; with fewer words, the whole sequence is one; without words, none."""
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        part = words[k:]
        rolled[: n - k] = mix64(rolled[: n - k] * np.uint64(_BASE) + part + np.uint64(k + 1))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[lo:hi]:
                    whole = mix64(np.array([whole * np.uint64(_BASE) + w + np.uint64(97)], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
