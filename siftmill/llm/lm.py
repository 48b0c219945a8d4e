"""Language-model scoring with a probabilistic suffix tree, beside a unigram base."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import durable
from siftmill.llm.kernels import IS_WORD, LOWER, chunks, mix64, text_column, word_hashes

#: Symbols of the longest context (7 at most: a gram is a 64-bit number); nats by which a context's statistics must diverge
#: from its parent's. The tree has every context that passes: the nats grow with its count, so the tree grows with the input.
DEPTH, DIVERGENCE = 6, 3.0
#: Contexts of up to so many symbols go to every executor; longer ones stay in buckets by the hash of their latest TOP + 1.
TOP = 2
#: Weight of the parent's distribution in a context's, and of each symbol in the root's.
BACKOFF, FLOOR = 16.0, 0.1
SPACE, END = 0x20, 0x0A
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries, sorted, and the place of each entry among them; faster than np.unique, as the sort need not be stable."""
    order = np.argsort(x)
    ordered = x[order]
    first = np.ones(len(x), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each by its bytes in turn: numbers that share their upper bytes then compress well."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, n * sum(sizes), asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * n
    return [np.ascontiguousarray(raw[e - z * n : e].reshape(z, n).T).view(k).reshape(n) for e, z, k in zip(ends.tolist(), sizes, kinds, strict=True)]


def symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's A-Z-folded words with a space after each and END last, and where the documents start."""
    n_docs = len(starts) - 1
    folded = LOWER[data]
    word = IS_WORD[folded]
    keep = word.copy()
    keep[1:] |= word[:-1]
    first = starts[:-1][starts[:-1] < starts[1:]]
    keep[first] = word[first]
    folded[~word] = SPACE
    # A document that ends in a word lacks the space after it.
    last = starts[1:] - 1
    full = starts[:-1] < starts[1:]
    short = np.zeros(n_docs, bool)
    short[full] = word[last[full]]
    before = np.concatenate([[0], np.cumsum(keep)])[starts]
    sizes = np.diff(before) + short + 1
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.full(begin[-1], END, np.uint8)
    kept = folded[keep]
    owner = np.repeat(np.arange(n_docs), np.diff(before))
    out[np.arange(len(kept)) - before[owner] + begin[owner]] = kept
    out[begin[1:][short] - 2] = SPACE
    return out, begin


def grams(text: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol with the `depth` before it, packed with the latest symbol lowest; 0xFF stands before a document.

    0xFF is no byte of UTF-8, so that it never is a symbol.
    """
    out = text.astype(np.uint64)
    place = np.arange(len(text)) - np.repeat(begin[:-1], np.diff(begin))
    for k in range(1, depth + 1):
        earlier = np.full(len(text), 0xFF, np.uint64)
        earlier[k:] = text[:-k] if k else text
        earlier[place < k] = 0xFF
        out |= earlier << np.uint64(8 * k)
    return out


def count_grams(docs: DataFrame, depth: int, in_training: Callable[[object], bool]) -> DataFrame:
    """gram, n: over the training rows of (doc_id, text)."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        names = ["gram", "n"]
        for batch in batches:
            train = np.array([in_training(x) for x in batch.column(0).to_pylist()], bool)
            data, offsets = text_column(batch.column(1).filter(pa.array(train)))
            for _, _, part, starts in chunks(data, offsets):
                keys, n = np.unique(grams(*symbols(part, starts), depth), return_counts=True)
                parts.append((keys, n))
                size += len(keys)
                if size > 3_000_000:
                    parts = [merge(parts)]
                    size = len(parts[0][0])
                    if size > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=names)
                        parts, size = [], 0
        if parts:
            keys, n = merge(parts)
            for lo in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 200_000].view(np.int64)), pa.array(n[lo : lo + 200_000])], names=names)

    return docs.mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Level:
    """The contexts of one length, from training counts of grams: those retained give their distributions.

    `counts` has the grams cut to the length and their counts, sorted; a context's grams lie together.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, d: int, above: Level | None, divergence: float = DIVERGENCE):
        self.mask = np.uint64((1 << 8 * (d + 1)) - 1)
        cut = grams & self.mask
        order = np.argsort(cut, kind="stable")
        cut, n = cut[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])) if len(cut) else np.zeros(0, np.int64)
        self.cut, self.n = cut[first], np.add.reduceat(n, first) if len(first) else n
        context = self.cut >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        self.context, self.m = context[first], np.add.reduceat(self.n, first) if len(first) else self.n
        self.root = d == 0
        self.kept = np.ones(len(first), bool)
        if above is not None and len(first):
            up_n, up_m, _ = above.find(self.cut)
            gain = self.n * np.log(self.n / np.repeat(self.m, np.diff([*first, len(self.n)])) / (up_n / up_m))
            self.kept = np.add.reduceat(gain, first) >= divergence

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each gram: its count, its context's count, and whether the context is retained."""
        out = []
        for value, known, n in ((grams & self.mask, self.cut, self.n), ((grams & self.mask) >> np.uint64(8), self.context, self.m)):
            at = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
            hit = known[at] == value if len(known) else np.zeros(len(value), bool)
            out.append(np.where(hit, n[at] if len(n) else 0, 0))
        return out[0], out[1], hit & self.kept[at] if len(known) else hit

    def refine(self, p: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Probabilities of the grams' symbols, from those in shorter contexts."""
        n, m, kept = self.find(grams)
        return (n + FLOOR) / (m + 256 * FLOOR) if self.root else np.where(kept, (n + BACKOFF * p) / (m + BACKOFF), p)


def levels(grams: np.ndarray, n: np.ndarray, lengths: range, above: Level | None = None, divergence: float = DIVERGENCE) -> list[Level]:
    """Levels of these lengths, the first of which is tested against `above`."""
    out: list[Level] = []
    for d in lengths:
        above = Level(grams, n, d, above, divergence)
        out.append(above)
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
MESSAGE = "block long, bucket long, data binary, n long, v long"


def held_out(key: object) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(key as text) mod 10 is 0 are held out; both models learn from the others alone. A null key is held
    out (its text is empty). Tokens are A-Z-folded words and one end. base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1)))
    over the tokens. score is the tree's log10 probability of the words, spelled in UTF-8 with a space after each, and
    the end. Null and empty texts consist of the end. Repeated rows count repeatedly; an empty table gives no rows.

    Blocks are dealt by key and text, so that null and repeated keys are spread over them. Word counts are exchanged between
    blocks of documents and buckets of words: a block sends each distinct word once
    with its training count and gets back the total. Likewise each distinct gram (a symbol with the DEPTH before it): its
    bucket has all grams whose contexts end alike, adds up their counts, tests the contexts and answers with the symbol's
    probability. Contexts of up to TOP symbols alone, whose number the alphabet bounds, go through the driver.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    blocks, buckets = max(1, total // block_bytes), max(1, total // bucket_bytes)
    rows = docs.select(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).alias("block"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    by_block = rows.groupBy("block")

    def words_of(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        data, offsets = text_column(table.column("text").combine_chunks())
        for lo, hi, part, starts in chunks(data, offsets):
            yield lo, hi, *word_hashes(part, starts)

    def vocabulary(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by (bucket, hash), training counts, first places of the buckets."""
        train = np.array([not held_out(x) for x in table.column("doc_id").to_pylist()], bool)
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi, words, first in words_of(table):
            learn = np.repeat(train[lo:hi], np.diff(first))
            found, back = numbered(words)
            keys.append(found)
            counts.append(np.bincount(back, learn, minlength=len(found)).astype(np.int64))
        key, count = np.concatenate(keys), np.concatenate(counts)
        key, back = numbered(key)
        count = np.bincount(back, count, minlength=len(key)).astype(np.int64)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return key[order], count[order], np.searchsorted(bucket[order], np.arange(buckets + 1))

    def message(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE) if rows else _MESSAGE.empty_table()

    def send(table: pa.Table) -> pa.Table:
        key, count, at = vocabulary(table)
        name = table.column("block")[0].as_py()
        return message([(name, b, key[x:y].tobytes() + count[x:y].tobytes(), 0, 0) for b, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x])

    def add(table: pa.Table) -> pa.Table:
        names, blobs = table.column("block").to_pylist(), table.column("data").to_pylist()
        parts = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in blobs]
        key, back = numbered(np.concatenate([p[0] for p in parts]))
        sums = np.bincount(back, np.concatenate([p[1] for p in parts]).astype(np.int64), minlength=len(key)).astype(np.int64)
        bucket = table.column("bucket")[0].as_py()
        out = [(n, bucket, x.tobytes(), 0, 0) for n, x in zip(names, np.split(sums[back], np.cumsum([p.shape[1] for p in parts])[:-1]), strict=True)]
        return message([*out, (-1, bucket, b"", int(sums.sum()), int((sums > 0).sum()))])

    answers = durable(by_block.applyInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(add, MESSAGE))
    n_words, n_distinct = answers.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    remainder = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10
    ends = docs.where(remainder != 0).count()
    n, v = n_words + ends, n_distinct + (ends > 0)

    pairs = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    common = count_grams(pairs, TOP, lambda x: not held_out(x)).toArrow()
    top = spark.sparkContext.broadcast(levels(common.column("gram").to_numpy().astype(np.uint64), common.column("n").to_numpy(), range(TOP + 1)))
    gram_buckets = max(1, 2 * total // bucket_bytes)

    def dealt(grams_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of distinct sorted grams by (bucket, gram), first places of the buckets."""
        latest = (grams_ >> np.uint64(8)) & np.uint64((1 << 8 * (TOP + 1)) - 1)
        bucket = (mix64(latest) % np.uint64(gram_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(gram_buckets + 1))

    def ask(table: pa.Table) -> pa.Table:
        train = np.array([not held_out(x) for x in table.column("doc_id").to_pylist()], bool)
        data, offsets = text_column(table.column("text").combine_chunks())
        found = []
        for lo, hi, part, starts in chunks(data, offsets):
            spelled, begin = symbols(part, starts)
            all_grams = grams(spelled, begin, DEPTH)
            own, n = np.unique(all_grams, return_counts=True)
            out, less = np.unique(all_grams[np.repeat(~train[lo:hi], np.diff(begin))], return_counts=True)
            n[np.searchsorted(own, out)] -= less
            found.append((own, n))
        own, back = numbered(np.concatenate([x[0] for x in found]))
        n = np.bincount(back, np.concatenate([x[1] for x in found]), minlength=len(own)).astype(np.int32)
        order, at = dealt(own)
        own, n = own[order], n[order]
        name = table.column("block")[0].as_py()
        # Differences of sorted numbers are small, and shuffles compress them.
        return message([(name, buckets + b, pack(np.diff(own[x:y], prepend=np.uint64(0)), n[x:y]), y - x, 0) for b, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x])

    def answer(table: pa.Table) -> pa.Table:
        names, blobs, sizes = (table.column(c).to_pylist() for c in ("block", "data", "n"))
        parts = [unpack(b, k, np.uint64, np.int32) for b, k in zip(blobs, sizes, strict=True)]
        own, back = numbered(np.concatenate([np.cumsum(x) for x, _ in parts]))
        n = np.bincount(back, np.concatenate([x for _, x in parts]), minlength=len(own)).astype(np.int64)
        seen = n > 0
        p = np.zeros(len(own))
        for level in [*top.value, *levels(own[seen], n[seen], range(TOP + 1, DEPTH + 1), top.value[TOP])]:
            p = level.refine(p, own)
        worth = np.log10(p).astype(np.float32)
        bucket = table.column("bucket")[0].as_py()
        return message([(name, bucket, pack(worth[x]), 0, 0) for name, x in zip(names, np.split(back, np.cumsum(sizes)[:-1]), strict=True)])

    told = by_block.applyInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(answer, MESSAGE)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        key, _, at = vocabulary(left)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        count = np.concatenate([np.frombuffer(got[b], np.int64) if y > x else np.zeros(0, np.int64) for b, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))])
        order = np.argsort(key)
        key, count = key[order], count[order]
        scale = np.log10(n + 0.1 * (v + 1))
        worth = np.log10(count + 0.1) - scale
        end = np.log10(ends + 0.1) - scale
        n_tokens, n_known, base, tree_score = (np.zeros(left.num_rows) for _ in range(4))
        for lo, hi, words, first in words_of(left):
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            place = np.searchsorted(key, words)
            n_tokens[lo:hi] = np.diff(first) + 1
            n_known[lo:hi] = np.bincount(owner, count[place] > 0, minlength=hi - lo) + (ends > 0)
            base[lo:hi] = np.bincount(owner, worth[place], minlength=hi - lo) + end
        data, offsets = text_column(left.column("text").combine_chunks())
        found = []
        for lo, hi, part, starts in chunks(data, offsets):
            spelled, begin = symbols(part, starts)
            own, back = numbered(grams(spelled, begin, DEPTH))
            found.append((lo, hi, own, back.astype(np.int32), np.diff(begin)))
        own = numbered(np.concatenate([x[2] for x in found]))[0]
        order, at = dealt(own)
        log_p = np.empty(len(own))
        log_p[order] = np.concatenate([unpack(got[buckets + b], y - x, np.float32)[0] for b, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x])
        for lo, hi, part, back, size in found:
            tree_score[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size), log_p[np.searchsorted(own, part)][back], minlength=hi - lo)
        ids = left.column("doc_id").to_pylist()
        return pa.table([pa.array(ids, pa.int64()), pa.array([held_out(x) for x in ids]), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(tree_score)], schema=schema)

    scored = by_block.cogroup(answers.where("block >= 0").unionByName(told).groupBy("block")).applyInArrow(score, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
