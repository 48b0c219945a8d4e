"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.kernels import chunks, mix64, text_column, word_hashes

#: 1: the token must agree, 0: it may differ. Together they hit every window of SPAN tokens with at most
#: SPAN - MIN_MATCH substitutions, which a test enumerates.
MASKS = ("11101101", "110100000111")
SPAN, MIN_MATCH = 16, 13
#: Items of fewer words than this have masks of their own length: MASKS miss some substitutions in them.
LEAST_WORDS = 13
#: Seed hashes of benchmark items sent to the executors at once (24 bytes each); larger benchmarks go in more blocks.
BLOCK_SEEDS = 1_000_000

HITS = "doc_id long, item_id long, n_matched int, doc_start int, item_start int, length int"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the unmasked words at every place where the mask fits into the sequence."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = mix64(out * np.uint64(31) + words[k : k + n]) if n > 0 else out
    return out


def short_masks(length: int) -> list[str]:
    """Masks as long as an item of `length` words, of which one keeps clear of any substitutions that the item may have.

    With s of them allowed, the places fall into s + 2 runs, and each mask leaves out s runs: s substitutions touch s at most.
    """
    most = length - -(-MIN_MATCH * length // SPAN)
    run = [k * (most + 2) // length for k in range(length)]
    return ["".join("01"[r not in out] for r in run) for out in combinations(range(most + 2), most)] if most else ["1" * length]


def best_window(same: np.ndarray, span: int) -> tuple[int, int]:
    """(matches, start) of the window of `span` places, or of all where there are fewer, with most matches."""
    width = min(span, len(same))
    sums = np.concatenate([[0], np.cumsum(same)])
    windows = sums[width:] - sums[:-width]
    at = int(windows.argmax())
    return int(windows[at]), at


class SeedIndex:
    """Seed hashes of a block of items, sorted, with a bit table that turns most lookups away."""

    BITS = 22

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.tables = []
        for mask in MASKS:
            found = [(h, np.full(len(h), k), np.arange(len(h))) for k, (_, words) in enumerate(items) if len(words) >= LEAST_WORDS and len(h := seeds(words, mask))]
            hashes, item, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << self.BITS, bool)
            table[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((hashes[order], item[order], place[order], table))
        # Short items are compared whole, by seeds of their own length.
        short: dict[str, dict[int, list[int]]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < LEAST_WORDS:
                for mask in short_masks(len(words)):
                    short.setdefault(mask, {}).setdefault(int(seeds(words, mask)[0]), []).append(k)
        self.short = [(mask, known, np.array(sorted(known), np.uint64)) for mask, known in short.items()]

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, document place minus item place) of every agreeing seed."""
        for mask, (hashes, item, place, table) in zip(MASKS, self.tables, strict=True):
            here = seeds(words, mask)
            at = np.flatnonzero(table[(here >> np.uint64(64 - self.BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, here[at], "left"), np.searchsorted(hashes, here[at], "right")
            n = hi - lo
            if n.sum():
                entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield item[entry], np.repeat(at, n) - place[entry]
        for mask, known, hashes in self.short:
            here = seeds(words, mask)
            for at in np.flatnonzero(np.isin(here, hashes)):
                for k in known[int(here[at])]:
                    yield np.array([k]), np.array([at])


def overlaps(index: SeedIndex, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, matches, document place, item place, compared length) of the items that the sequence of words contains."""
    pairs = [np.stack(x) for x in index.hits(words)]
    if not pairs:
        return []
    best: dict[int, tuple[int, int, int, int]] = {}
    for k, shift in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
        item = index.items[k][1]
        lo, hi = max(0, -shift), min(len(item), len(words) - shift)
        same = item[lo:hi] == words[lo + shift : hi + shift]
        width = min(SPAN, len(item))
        if hi - lo < width:
            continue
        matched, at = best_window(same, width)
        if matched * SPAN >= MIN_MATCH * width:
            whole = int(same.sum())
            if k not in best or whole > best[k][0]:
                best[k] = whole, lo + at + shift, lo + at, hi - lo
    return [(k, *v) for k, v in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """One row for each document and benchmark item that overlap.

    Words are A-Z-folded runs without whitespace. Seeds of a mask of item and document must agree somewhere, which they do
    wherever the pair is to be reported; around each hit the aligned words are compared, and the pair is reported where a
    window of 16 words agrees in 13 or more (shorter items: in that share of all their words). n_matched: agreeing words of the whole aligned
    range, whose longest alignment is kept; doc_start, item_start: first word of the best window; length: words compared.

    The benchmark is a stated query set: it is sent to the executors in blocks of at most `block_seeds` seed hashes, each
    compared with all documents in one scan. Null and empty texts match nothing. Null keys are kept as null; repeated
    rows give repeated results; items with the same text are all reported.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        hashed = []
        for ident, content in block:
            raw = np.frombuffer((content or "").encode(), np.uint8)
            hashed.append((ident, word_hashes(raw, np.array([0, len(raw)]))[0]))
        shared = spark.sparkContext.broadcast(hashed)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                data, offsets = text_column(batch.column(1))
                out = []
                for lo, _, part, starts in chunks(data, offsets):
                    words, first = word_hashes(part, starts)
                    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                        out += [(ids[lo + d], index.items[k][0], m, x, y, n) for k, m, x, y, n in overlaps(index, words[a:b])]
                columns = zip(*out, strict=True) if out else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        return rows.mapInArrow(each, HITS)

    out, block, size = None, [], 0
    for item in benchmark.select(F.col(item_key).cast("long"), F.col(item_text)).toLocalIterator():
        n = len(MASKS) * ((len(item[1] or "") + 1) // 2)
        if block and size + n > block_seeds:
            out, block, size = (scan(block) if out is None else out.unionByName(scan(block))), [], 0
        block, size = [*block, tuple(item)], size + n
    if block:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out if out is not None else spark.createDataFrame([], T._parse_datatype_string(HITS))
