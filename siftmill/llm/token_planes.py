"""Token ids in bit-plane files: encode texts, transpose blocks of ids into planes, compress each plane, index the chunks.

A file holds the ids of whole documents that follow each other. All numbers in it are little-endian:

    magic, kind of planes (u8), ids in a block (u32)
    the planes of block 0, of block 1, ...: each a zstandard frame, or nothing for a plane of zeros
    chunk index: for each block its offset and the length of each of its planes (zstandard)
    document table: key, whether the key is null, number of ids (zstandard)
    footer: offset and length of the index, length of the table, ids, documents, magic

A block is decoded from its own planes alone, so that any run of ids is read from the blocks that it meets. Files are the
binary `content` of table rows, as Spark's binaryFile source has them: Spark writes and commits them where all executors
can read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm.common import durable, small

MAGIC = b"BPLN"
HEAD, FOOT = struct.Struct("<4sBI"), struct.Struct("<QQQQQ4s")
#: Byte planes are the default: of the ids of the test tables they leave 0.67 of 16 bits an id, bit planes 0.79.
BYTE_PLANES, BIT_PLANES = 0, 1
N_PLANES = {BYTE_PLANES: 4, BIT_PLANES: 32}
#: Ids of a block, and ids after which a file is closed at the end of a document.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 20
LEVEL = 3
#: Characters of text in work at once, and parts of text after which what a worker has learnt is emptied.
PIECE_CHARS, MOST_PARTS = 1 << 20, 900_000

FILES = "part int, seq int, n_docs long, n_ids long, content binary"
READ = "doc_id long, part int, seq int, place long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block, from the lowest; a plane of zeros is empty."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    out = []
    for k in range(4):
        column = columns[:, k]
        if kind == BYTE_PLANES:
            out.append(column.tobytes() if column.any() else b"")
        else:
            used = int(np.bitwise_or.reduce(column)) if len(column) else 0
            out += [np.packbits((column >> b) & 1).tobytes() if used >> b & 1 else b"" for b in range(8)]
    return out


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    columns = np.zeros((n, 4), np.uint8)
    for k in range(4):
        if kind == BYTE_PLANES:
            if planes[k]:
                columns[:, k] = np.frombuffer(planes[k], np.uint8)
            continue
        for b in range(8):
            if plane := planes[8 * k + b]:
                columns[:, k] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << b
    return columns.reshape(-1).view("<u4")


# ---------------------------------------------------------------- files


class FileWriter:
    """Builds one file; no more than a block of ids waits uncompressed."""

    def __init__(self, kind: int = BYTE_PLANES, block: int = BLOCK_IDS):
        self.kind, self.block = kind, block
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.size = [HEAD.pack(MAGIC, kind, block)], HEAD.size
        self.index: list[list[int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        while len(ids):
            part = ids[: self.block - self.n_waiting]
            self.waiting.append(part)
            self.n_waiting += len(part)
            ids = ids[len(part) :]
            if self.n_waiting == self.block:
                self._flush()

    def _flush(self) -> None:
        frames = [self.zstd.compress(p) if p else b"" for p in to_planes(np.concatenate(self.waiting), self.kind)]
        self.index.append([self.size, *map(len, frames)])
        self.out += frames
        self.size += sum(map(len, frames))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> bytes:
        if self.n_waiting:
            self._flush()
        index = self.zstd.compress(np.array(self.index, "<u8").tobytes())
        nulls = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        table = self.zstd.compress(keys.tobytes() + nulls.tobytes() + np.array(self.lengths, "<u8").tobytes())
        foot = FOOT.pack(self.size, len(index), len(table), self.n_ids, len(self.keys), MAGIC)
        return b"".join([*self.out, index, table, foot])


class FileReader:
    """Reads a file's documents, or any run of its ids."""

    def __init__(self, content: bytes):
        magic, self.kind, self.block = HEAD.unpack_from(content)
        at, n_index, n_table, self.n_ids, n_docs, end = FOOT.unpack_from(content, len(content) - FOOT.size)
        if magic != MAGIC or end != MAGIC:
            raise ValueError("no plane file, or a cut one")
        self.content, self.zstd = memoryview(content), zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.zstd.decompress(self.content[at : at + n_index]), "<u8").astype(np.int64).reshape(-1, 1 + N_PLANES[self.kind])
        table = self.zstd.decompress(self.content[at + n_index : at + n_index + n_table])
        keys, nulls = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        self.keys = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)]
        self.ends = np.cumsum(np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64))
        self.held: tuple[int, np.ndarray] = -1, np.zeros(0, np.uint32)

    def _block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            at, *lengths = self.index[k].tolist()
            planes = []
            for n in lengths:
                planes.append(self.zstd.decompress(self.content[at : at + n]) if n else b"")
                at += n
            self.held = k, from_planes(planes, min(self.block, self.n_ids - k * self.block), self.kind)
        return self.held[1]

    def run(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids from place `start` to before `end`, in pieces of at most a block."""
        while start < end:
            k = start // self.block
            upto = min(end, (k + 1) * self.block)
            yield self._block(k)[start - k * self.block : upto - k * self.block]
            start = upto

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """key, start and end of each document."""
        start = 0
        for key, end in zip(self.keys, self.ends.tolist(), strict=True):
            yield key, start, end
            start = end


# ---------------------------------------------------------------- encoding


class Encoder:
    """A tokenizer of the tokenizers library, and what it gave for parts of text that come again.

    The parts are such that their encodings joined are that of the text: white space, which the tokenizer drops, cuts any
    text, and in Latin-1 text without special tokens, which its normaliser leaves alone but for the case, the matches of
    its splitting pattern are encoded one by one. A tokenizer with another normaliser or pattern encodes whole texts.
    """

    #: The normaliser and the splitting pattern that the parts are made for.
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: The same pattern for lower-case Latin-1 text.
    LATIN = re.compile("[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+".format(L="a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", N="0-9\xb2\xb3\xb9\xbc-\xbe", S="\t-\r \x85\xa0"))

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        self.tokenizer = Tokenizer.from_str(tokenizer)
        said = json.loads(tokenizer)
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = steps[0].get("pattern") == {"Regex": self.PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        self.parts = bool((said.get("normalizer") or {}).get("normalizers") == self.NORMAL and split and said.get("post_processor") is None)
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        #: Ids with which a word ends, where the model marks them.
        suffix = (said.get("model") or {}).get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def _learn_words(self, words: list[str]) -> None:
        """Encodes words in one text and cuts it where the model marks their ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *at], at)), strict=True))
        else:
            self.known.update(zip(words, self._whole(words), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> tuple[list[str], bool]:
        """Parts of a text, and whether all of them are words of Latin-1 letters, digits or signs."""
        if any(s in text for s in self.special):
            return [text], False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            units = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            return [p for u in units for p in (self._parts(u)[0] if len(units) > 1 else [u])], False
        return self.LATIN.findall(text.lower()), True

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not self.parts:
            return self._whole([text])[0]
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else -1
            end = len(text) if end < 0 else end
            parts, words = self._parts(text[at:end])
            if new := [p for p in set(parts) if p not in self.known]:
                if len(self.known) + len(new) > MOST_PARTS:
                    self.known.clear()
                    new = list(set(parts))
                if words:
                    self._learn_words(new)
                else:
                    self.known.update(zip(new, self._whole(new), strict=True))
            out += map(self.known.__getitem__, parts)
            at = end
        return b"".join(out)


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One for each worker: what it has learnt serves later tasks as well."""
    key = zlib.crc32(tokenizer.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer)
    return _encoders[key]


# ---------------------------------------------------------------- tables


def token_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, kind: int = BYTE_PLANES) -> DataFrame:
    """part, seq, n_docs, n_ids, content: files with every document's ids and `end_id`, in ascending order of the key.

    `tokenizer` is the path of a tokenizer file, read on the driver and sent to the executors (a vocabulary of some
    megabytes). Null keys come first; rows with equal keys are ordered by a hash of their texts, so that any run gives the same
    ids. Rows that tie in both are equal, and are spread over partitions, however many they are. A null or empty text
    is `end_id` alone. Strings of special tokens in a text become these tokens, as the library does it. Files are in order
    by (part, seq) and hold whole documents; a document longer than FILE_IDS has a file that ends with it. An empty table
    gives no file. Other columns are left out.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(shared.value).encode, TaskContext.get().partitionId()
        writer, seq = FileWriter(kind), 0

        def closed() -> pa.RecordBatch:
            row = [[part], [seq], [len(writer.keys)], [writer.n_ids], [writer.close()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_docs", "n_ids", "content"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(k, np.concatenate([np.frombuffer(encode(t.as_py() or ""), "<u4"), end]))
                if writer.n_ids >= FILE_IDS:
                    yield closed()
                    writer, seq = FileWriter(kind), seq + 1
        if writer.keys:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).select("k", "t", F.xxhash64("t").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    ranged = rows.repartitionByRange(F.col("k").asc_nulls_first(), "h", "salt")
    return ranged.sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "t").select("k", "t").mapInArrow(each, FILES)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, part, seq, place (ids before it in its file), n_tokens, ids_crc32 of every document in the files.

    A file is decoded block by block, however long its documents are.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                reader, rows = FileReader(content.as_py()), []
                for key, start, end in reader.documents():
                    crc = 0
                    for ids in reader.run(start, end):
                        crc = zlib.crc32(ids.tobytes(), crc)
                    rows.append((key, part.as_py(), seq.as_py(), start, end - start, crc))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return files.select("part", "seq", "content").mapInArrow(each, READ)


def with_starts(files: DataFrame) -> DataFrame:
    """part, seq, base: the ids of all files before each file.

    Parts are summed first: one row for each part is what a single task orders.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("part", "seq", "n_ids").join(parts.select("part", before.alias("b")), "part").select("part", "seq", (F.col("b") + inside).alias("base"))


def token_columns(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, kind: int = BYTE_PLANES) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files that `token_files` makes and Spark writes.

    Every row gives one row, also with a null or repeated key (see `token_files` for their order); an empty table gives none.
    """
    files = durable(token_files(docs, tokenizer, key, text, end_id, kind))
    read = read_tokens(files).join(small(with_starts(files)), ["part", "seq"])
    return read.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
