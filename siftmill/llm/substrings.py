"""Repeated-substring removal: distributed prefix doubling over sampled suffix positions.

The suffixes that matter are those whose first `length` bytes repeat. Two rounds of prefix doubling rank them: the first
ranks prefixes of h bytes, half the length, the second ranks pairs (rank at p, rank at p + length - h), which are
prefixes of `length` bytes. A suffix whose rank is unique after the first round cannot repeat and leaves.

Ranking every byte position would move ten times the text through the shuffle. So the first round ranks anchors: of each
window of `length` bytes, the first h-byte prefix with the smallest fingerprint. Equal windows have the same anchor at the
same offset, so a window repeats only if its anchor does. The second round ranks all windows of the anchors that are left.

Ranks are exchanged between blocks (documents by key hash, some megabytes of text each) and buckets (anchors by
fingerprint). A block sends each distinct anchor or stretch of text once per bucket, whatever the number of its copies,
and the bucket sorts what it gets, ranks it and answers entry by entry in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.kernels import mix64, powers, prefix_hash, text_column

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
SEGMENT = 1 << 19
_PLACE_BITS = np.uint64(20)
_PLACE = np.uint64((1 << 20) - 1)

MESSAGE = "block long, kind int, bucket long, data binary"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary"


def half_length(length: int) -> int:
    """Bytes of the first round's prefixes: half the length, or so many that a run has at most 64 windows."""
    return max(-(-length // 2), length - 63)


def fixed_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the `width` bytes from each position on."""
    n = len(sums) - width
    return mix64((sums[width:] - sums[:n]) * powers(len(sums))[1][:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Windows:
    """The windows of a segment of concatenated texts, gathered into runs that share an anchor.

    key: fingerprint of each run's anchor; lo, hi: first and last window start in the segment; doc: row.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        h = half_length(length)
        self.data = data
        n = len(data) - length + 1
        empty = np.zeros(0, np.int64)
        self.key, self.lo, self.hi, self.doc = np.zeros(0, np.uint64), empty, empty, empty
        if n < 1:
            return
        ranks = fixed_hash(prefix_hash(data), h)
        packed = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)
        anchor = (sliding_min(packed, length - h + 1) & _PLACE).astype(np.int64)[:n]
        doc = np.searchsorted(starts, np.arange(n), "right") - 1
        inside = np.arange(n) + length <= starts[doc + 1]
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        first = np.flatnonzero(change & inside)
        last = np.ones(n, bool)
        last[:-1] = change[1:] | ~inside[1:]
        self.lo, self.hi = first, np.flatnonzero(last & inside)
        self.key, self.doc = ranks[anchor[first]], doc[first]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows, offset of each piece in its text) of at most about SEGMENT bytes.

    Longer texts are cut into pieces that overlap by length - 1 bytes, so that each window is in one piece.
    """
    pieces: list[tuple[int, int, int]] = []
    size = 0
    step = SEGMENT - length + 1

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [data[offsets[r] + a : offsets[r] + b] for r, a, b in pieces]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.concatenate(parts), starts, np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])

    lengths = np.diff(offsets).tolist()
    for row, total in enumerate(lengths):
        for a in range(0, max(1, total - length + 1), step):
            b = min(total, a + SEGMENT)
            if b - a < length:
                continue
            if pieces and size + b - a > SEGMENT:
                yield made()
                pieces, size = [], 0
            pieces.append((row, a, b))
            size += b - a
    if pieces:
        yield made()


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


class Block:
    """Documents of one block, by ascending key; a null key takes no part."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        ids = table.column("doc_id").combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end")
        table = table.take(order)
        self.n_keyed = len(ids) - ids.null_count
        self.keys = table.column("doc_id").combine_chunks().to_pylist()
        self.ids = np.array([x for x in self.keys if x is not None], np.int64)
        self.data, self.offsets = text_column(table.column("text").combine_chunks())
        self.length, self.buckets = length, buckets

    def windows(self) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        for data, starts, rows, shift in segments(self.data, self.offsets[: self.n_keyed + 1], self.length):
            w = Windows(data, starts, self.length)
            yield w, rows, shift - starts[:-1]

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors by (bucket, rank), whether each is in more than one document here, and first places of buckets."""
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w, rows, _ in self.windows():
            keys.append(w.key)
            docs.append(self.ids[rows[w.doc]])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        key = key[first]
        bucket = self.bucket_of(key)
        order = np.argsort(bucket, kind="stable")
        return key[order], several[order], np.searchsorted(bucket[order], np.arange(self.buckets + 1))

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Sorted ranks of the anchors that the buckets found in more than one document."""
        key, _, at = self.anchors()
        bits = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=at[b + 1] - at[b]).astype(bool) if b in answers else np.zeros(at[b + 1] - at[b], bool) for b in range(self.buckets)]
        return np.sort(key[np.concatenate(bits)]) if bits else key[:0]

    def stretches(self, repeated: np.ndarray) -> Iterator[tuple[Windows, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of windows whose anchor repeats: (windows, row of each run, run indices, place shift of each run)."""
        for w, rows, shift in self.windows():
            if len(repeated) and len(w.key):
                at = np.minimum(np.searchsorted(repeated, w.key), len(repeated) - 1)
                runs = np.flatnonzero(repeated[at] == w.key)
                if len(runs):
                    yield w, rows[w.doc[runs]], runs, shift[w.doc[runs]]

    def distinct(self, repeated: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]], np.ndarray]:
        """Distinct stretches by (bucket, fingerprint): of each, fingerprint, key, first document's row and segment place."""
        prints, keys, rows, part, lo, hi = [], [], [], [], [], []
        parts = []
        for w, row, runs, _ in self.stretches(repeated):
            sums = prefix_hash(w.data)
            a, b = w.lo[runs], w.hi[runs] + self.length
            prints.append(mix64((sums[b] - sums[a]) * powers(len(sums))[1][a] ^ (b - a).astype(np.uint64) ^ (w.key[runs] << np.uint64(1))))
            keys.append(w.key[runs])
            rows.append(row)
            lo.append(a)
            hi.append(b)
            part.append(np.full(len(runs), len(parts)))
            parts.append(w.data)
        if not parts:
            return np.zeros(0, np.uint64), [], np.zeros(self.buckets + 1, np.int64)
        prints, keys, rows, part, lo, hi = (np.concatenate(x) for x in (prints, keys, rows, part, lo, hi))
        order = np.lexsort((rows, prints))
        first = order[np.concatenate([[True], prints[order][1:] != prints[order][:-1]])]
        first = first[np.argsort(self.bucket_of(keys[first]), kind="stable")]
        bucket = self.bucket_of(keys[first])
        return prints[first], [parts, part[first], lo[first], hi[first], rows[first]], np.searchsorted(bucket, np.arange(self.buckets + 1))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


_MESSAGE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", with_text: bool = True, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document with a smaller key.

    Texts count as UTF-8 bytes, null as empty. Strings are judged on the input and do not cross documents. Returns per
    row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, starts and ends of the runs, and the
    kept bytes (null unless `with_text`), which need not be valid UTF-8 where a run cuts a character. Rows that share a key do not remove each
    other's bytes. A row with a null key is returned unchanged and removes nothing. An empty table gives no rows.
    """
    if length < 16:
        raise ValueError("lengths under 16 bytes repeat everywhere")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    blocks, buckets = max(1, total // block_bytes), max(1, total // bucket_bytes)
    rows = docs.select(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("block"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    by_block = lambda df: df.groupBy("block")

    def send_anchors(table: pa.Table) -> pa.Table:
        name = table.column("block")[0].as_py()
        keys, several, at = Block(table, length, buckets).anchors()
        out = [(name, 0, b, keys[x:y].tobytes() + np.packbits(several[x:y]).tobytes()) for b, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x]
        return _arrow(out, _MESSAGE)

    def rank_anchors(table: pa.Table) -> pa.Table:
        """Sort the ranks of all blocks; an entry is repeated if another block sent it, or two documents of its own."""
        names, blobs = table.column("block").to_pylist(), table.column("data").to_pylist()
        keys, several = [], []
        for blob in blobs:
            n = (8 * len(blob)) // 65
            while 8 * n + -(-n // 8) < len(blob):
                n += 1
            keys.append(np.frombuffer(blob, np.uint64, n))
            several.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 * n), count=n).astype(bool))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        hit = np.zeros(len(every), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        hit |= np.concatenate(several)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        bucket = table.column("bucket")[0].as_py()
        return _arrow([(n, 1, bucket, np.packbits(x).tobytes()) for n, x in zip(names, np.split(hit, cuts), strict=True) if x.any()], _MESSAGE)

    def answers(table: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: d for k, b, d in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind}

    def send_stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _MESSAGE.empty_table()
        name = left.column("block")[0].as_py()
        block = Block(left, length, buckets)
        _, found, at = block.distinct(block.repeated(answers(right, 1)))
        out = []
        for b, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if y > x:
                parts, part, lo, hi, row = (found[0], *(f[x:y] for f in found[1:]))
                body = b"".join(parts[p][i:j].tobytes() for p, i, j in zip(part.tolist(), lo.tolist(), hi.tolist(), strict=True))
                head = np.array([y - x], np.int64).tobytes() + block.ids[row].tobytes() + (hi - lo).astype(np.int32).tobytes()
                out.append((name, 2, b, _pack(head + body)))
        return _arrow(out, _MESSAGE)

    def rank_stretches(table: pa.Table) -> pa.Table:
        """Rank all windows by their pair of half ranks; answer which windows of a stretch start in a smaller document too."""
        names, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        counts, ids, sizes, bodies = [], [], [], []
        for blob in table.column("data"):
            raw = _unpack(blob.as_py())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            counts.append(n)
            ids.append(np.frombuffer(raw, np.int64, n, 8))
            sizes.append(np.frombuffer(raw, np.int32, n, 8 + 8 * n))
            bodies.append(np.frombuffer(raw, np.uint8, offset=8 + 12 * n))
        doc, size, data = np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(bodies)
        h = half_length(length)
        begin = np.concatenate([[0], np.cumsum(size)])
        windows = size - length + 1
        pairs, lo = [], 0
        while lo < len(size):  # a piece of the text at a time: fingerprints take many times its bytes
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SEGMENT, "right")) - 1)
            half = fixed_hash(prefix_hash(data[begin[lo] : begin[hi]]), h)
            place = np.repeat(begin[lo:hi] - begin[lo] - np.cumsum(windows[lo:hi]) + windows[lo:hi], windows[lo:hi]) + np.arange(windows[lo:hi].sum())
            pairs.append(mix64(half[place] * np.uint64(0x9E3779B97F4A7C15) + half[place + (length - h)]))
            lo = hi
        pair = np.concatenate(pairs)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), windows)
        shift = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.uint8)
        order = np.argsort(pair)
        pair, ranked = pair[order], doc[owner[order]]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(ranked, first), np.diff(np.append(first, len(pair))))
        hit = np.zeros(len(owner), bool)
        hit[order] = smallest < ranked
        mask = np.add.reduceat(np.where(hit, np.uint64(1) << shift.astype(np.uint64), np.uint64(0)), np.cumsum(windows) - windows)
        cuts = np.cumsum(counts)[:-1]
        return _arrow([(n, 3, bucket, _pack(x.tobytes())) for n, x in zip(names, np.split(mask, cuts), strict=True)], _MESSAGE)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        block = Block(left, length, buckets)
        spans: list[list[np.ndarray]] = [[] for _ in block.keys]
        repeated = block.repeated(answers(right, 1)) if right.num_rows else np.zeros(0, np.uint64)
        if len(repeated):
            prints, found, at = block.distinct(repeated)
            masks = {b: np.frombuffer(_unpack(d), np.uint64) for b, d in answers(right, 3).items()}
            hit = np.concatenate([masks.get(b, np.zeros(at[b + 1] - at[b], np.uint64)) for b in range(buckets)])
            order = np.argsort(prints)
            prints, hit, holder = prints[order], hit[order], found[4][order] if found else None
            for w, row, runs, shift in block.stretches(repeated):
                sums = prefix_hash(w.data)
                a, b = w.lo[runs], w.hi[runs] + length
                mine = mix64((sums[b] - sums[a]) * powers(len(sums))[1][a] ^ (b - a).astype(np.uint64) ^ (w.key[runs] << np.uint64(1)))
                at_ = np.searchsorted(prints, mine)
                whole = block.ids[row] > block.ids[holder[at_]]
                mask = np.where(whole, ~np.uint64(0), hit[at_])
                width = w.hi[runs] - w.lo[runs] + 1
                run = np.repeat(np.arange(len(runs)), width)
                offset = np.arange(len(run)) - np.repeat(np.cumsum(width) - width, width)
                take = ((mask[run] >> offset.astype(np.uint64)) & np.uint64(1)).astype(bool)
                place, owner = (w.lo[runs][run] + offset + shift[run])[take], row[run][take]
                for r, x, y in zip(*_groups(owner), strict=True):
                    spans[r].append(place[x:y])
        rows = []
        for r, ident in enumerate(block.keys):
            body = block.data[block.offsets[r] : block.offsets[r + 1]]
            begins, ends, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), body
            if spans[r]:
                marked = np.unique(np.concatenate(spans[r]))
                gap = np.diff(marked) > length
                begins = marked[np.concatenate([[True], gap])]
                ends = marked[np.concatenate([gap, [True]])] + length
                kept = np.concatenate([body[i:j] for i, j in zip([0, *ends.tolist()], [*begins.tolist(), len(body)], strict=True)])
            content = kept.tobytes()
            rows.append((ident, len(body), len(body) - len(content), len(begins), hashlib.sha256(content).hexdigest(), begins.tolist(), ends.tolist(), content if with_text else None))
        return _arrow(rows, schema)

    anchors = by_block(rows).applyInArrow(send_anchors, MESSAGE)
    flags = anchors.groupBy("bucket").applyInArrow(rank_anchors, MESSAGE)
    stretches = by_block(rows).cogroup(by_block(flags)).applyInArrow(send_stretches, MESSAGE)
    masks = stretches.groupBy("bucket").applyInArrow(rank_stretches, MESSAGE)
    return by_block(rows).cogroup(by_block(flags.unionByName(masks))).applyInArrow(cut, REMOVED)


def _groups(owner: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values, starts and ends of runs of equal entries."""
    if not len(owner):
        return [], [], []
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first].tolist(), first.tolist(), [*first[1:].tolist(), len(owner)]
