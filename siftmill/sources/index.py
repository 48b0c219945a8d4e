"""The chunk index: versions of rows that are merged when read, with a manifest of files and postings of terms."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from siftmill.functions import text as tx
from siftmill.sources.versions import Conflict, VersionLog

SCHEMA = "chunk_id string, file_path string, header string, line_start int, chunk_index int, text string, window_text string, source_sha string, vector array<float>"
#: Columns that an index gets when the first rows with them arrive; older rows have nulls.
SPARSE = "sparse_indices array<bigint>, sparse_values array<float>"
#: Rows up to which the keys of later versions are sent to all executors.
SMALL_ROWS = 100_000
#: Versions after a base from which a change also makes a new base.
MOST_DELTAS = 16
#: Chunks in a range of the sparse postings, a power of two: what a block may hold of a term.
RANGE_BITS = 7
#: Bytes that the dictionary of a column of postings may have.
DICTIONARY_BYTES = 8 << 20
#: Postings of a sorted run: what a task holds and sorts at once, however large its share is.
RUN_POSTINGS = 1 << 20
#: How the parts of an index are compressed.
CODEC = "zstd"


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose hash is empty or differs from the stored one. files: path, sha, ...; stored: file_path, source_sha."""
    known = stored.select(F.col("file_path").alias("path"), F.col("source_sha").alias("sha")).where("sha <> ''")
    return files.join(known, ["path", "sha"], "left_anti")


def file_shas(chunks: DataFrame) -> DataFrame:
    """One hash for each file: that of its last chunk by id; files without a path are left out."""
    return chunks.where("file_path <> ''").groupBy("file_path").agg(F.max_by("source_sha", "chunk_id").alias("source_sha"))


def lookup_sha(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, source_sha of the wanted files: that of their first chunk by id, or the empty string."""
    first = chunks.groupBy("file_path").agg(F.min_by("source_sha", "chunk_id").alias("source_sha"))
    return files.select("file_path").join(first, "file_path", "left").select("file_path", F.coalesce("source_sha", F.lit("")).alias("source_sha"))


def point_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n"))


def one_per_id(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, or one row of each key (which is of equal keys does not matter) if a count finds equal ones. Rows with distinct keys are not moved."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return rows if repeated.isEmpty() else one_per_id(rows, key, [F.col(key)])


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: list | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; of equal keys in `new` the first by `order` stays."""
    fresh = one_per_id(new, key, order or [F.col(key)])
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def delete_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_path"), "file_path", "left_anti").select(*chunks.columns)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcasting if it has no more than SMALL_ROWS rows, by a number that the log holds; else left to a shuffled join."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


# ---------------------------------------------------------------- what a version holds besides its rows


def file_entries(rows: DataFrame) -> DataFrame:
    """file_path, its first and last chunk by id with their hashes, and its number of chunks."""
    of = lambda pick, what: pick(what, "chunk_id")
    return rows.groupBy("file_path").agg(
        F.min("chunk_id").alias("first_id"), of(F.min_by, "source_sha").alias("first_sha"), F.max("chunk_id").alias("last_id"), of(F.max_by, "source_sha").alias("last_sha"), F.count("*").alias("n")
    )


def text_postings(rows: DataFrame) -> DataFrame:
    """term, chunk_id of each distinct word of each chunk, in runs of about RUN_POSTINGS that are sorted by both.

    A task turns over one run at a time: no sort holds or spills the postings of a whole task.
    """
    return rows.select("chunk_id", F.array_distinct(tx.word_tokens(F.col("text"))).alias("terms")).mapInArrow(_term_runs, "term string, chunk_id string")


def _term_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for piece, size in (p for batch in batches for p in _pieces(batch)):
        if held and n + size > RUN_POSTINGS:
            yield _terms_of(pa.Table.from_batches(held))
            held, n = [], 0
        held.append(piece)
        n += size
    if n:
        yield _terms_of(pa.Table.from_batches(held))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows of a batch (id, list) in pieces whose lists hold at most RUN_POSTINGS values, unless one list has more; their numbers of values."""
    sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    upto, lo = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + RUN_POSTINGS, "right")) - 1)
        yield batch.slice(lo, hi - lo), int(upto[hi] - upto[lo])
        lo = hi


def _terms_of(chunks: pa.Table) -> pa.RecordBatch:
    """The postings of some chunks (chunk_id, terms), sorted by word and id."""
    chunks = chunks.sort_by("chunk_id").combine_chunks()
    ids, terms = (chunks.column(k).combine_chunks() for k in (0, 1))
    coded = terms.flatten().dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int32)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place), dtype=np.int32)
    order = pa.array(np.argsort(place[coded.indices.to_numpy()], kind="stable"))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(coded.indices.take(order)), ids.take(pc.list_parent_indices(terms).take(order))], names=["term", "chunk_id"])


def sparse_blocks(rows: DataFrame) -> DataFrame:
    """i, range, most, least, n, ids, weights: what the chunks of a range have under each sparse index, in one row.

    Chunks are put into ranges of 2 ** RANGE_BITS in the order of their largest weight, so that the heavy ones share ranges and the
    largest weights of the other ranges are small: these bound what a range can score. Of a repeated index the last value
    counts; null arrays have no postings. The chunks' arrays are moved once, as they are stored; a range is turned over where it
    lies. Blocks are sorted by index, the largest weights first, in runs of about RUN_POSTINGS.
    """
    held = rows.where(F.col("sparse_indices").isNotNull()).select("chunk_id", "sparse_indices", "sparse_values")
    heavy = held.withColumn("_most", F.coalesce(F.array_max("sparse_values").cast("double"), F.lit(0.0)))
    ordered = heavy.repartitionByRange(F.col("_most").desc(), "chunk_id").sortWithinPartitions(F.col("_most").desc(), "chunk_id")
    return ordered.select("chunk_id", F.col("sparse_indices").cast("array<bigint>").alias("i"), F.col("sparse_values").cast("array<double>").alias("w")).mapInArrow(_block_runs, BLOCKS)


BLOCKS = "i bigint, range bigint, most double, least double, n bigint, ids array<string>, weights array<double>"


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for blocks in _turned(batches):
        size = len(blocks.column(5).values)
        if held and n + size > RUN_POSTINGS:
            yield from _sorted_blocks(held)
            held, n = [], 0
        held.append(blocks)
        n += size
    if held:
        yield from _sorted_blocks(held)


def _sorted_blocks(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(held).combine_chunks().sort_by([("i", "ascending"), ("most", "descending")]).combine_chunks().to_batches()


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a partition's ranges. A range's number has the partition in its upper bits, so that none spans two."""
    size, number, left = 1 << RANGE_BITS, TaskContext.get().partitionId() << 33 - RANGE_BITS, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        whole = table.num_rows - table.num_rows % size
        for lo in range(0, whole, size):
            yield _blocks_of(table.slice(lo, size), number)
            number += 1
        left = table.slice(whole)
    if left is not None and left.num_rows:
        yield _blocks_of(left, number)


def _blocks_of(chunks: pa.Table, number: int) -> pa.RecordBatch:
    """The blocks of one range of chunks (chunk_id, i, w)."""
    chunks = chunks.sort_by("chunk_id").combine_chunks()
    indices, weights = (chunks.column(k).combine_chunks() for k in (1, 2))
    sizes = pc.list_value_length(indices).fill_null(0).to_numpy(zero_copy_only=False)
    if np.array_equal(sizes, pc.list_value_length(weights).fill_null(0).to_numpy(zero_copy_only=False)):
        i, w = (c.flatten() for c in (indices, weights))
    else:  # of arrays of two lengths what has a partner counts
        pairs = [list(zip(x or [], y or [])) for x, y in zip(indices.to_pylist(), weights.to_pylist(), strict=True)]
        sizes = np.array([len(p) for p in pairs])
        i, w = (pa.array([x[k] for p in pairs for x in p], kind) for k, kind in ((0, pa.int64()), (1, pa.float64())))
    i, w = i.fill_null(0).to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)  # a null weight is NaN
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    good = ~np.isnan(w)
    i, w, chunk = i[good], w[good], chunk[good]
    order = np.lexsort((np.arange(len(i)), chunk, i))
    i, w, chunk = i[order], w[order], chunk[order]
    last = np.ones(len(i), bool)
    last[:-1] = (i[1:] != i[:-1]) | (chunk[1:] != chunk[:-1])
    i, w, chunk = i[last], w[last], chunk[last]
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(i)), pa.int32())
    ids = chunks.column(0).combine_chunks().take(pa.array(chunk)) if len(i) else pa.array([], pa.string())
    most, least = (np.maximum.reduceat(w, starts), np.minimum.reduceat(w, starts)) if len(i) else (w, w)
    columns = [pa.array(i[starts]), pa.array(np.full(len(starts), number, np.int64)), pa.array(most), pa.array(least), pa.array(np.diff(np.append(starts, len(i))).astype(np.int64)), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(w))]
    return pa.RecordBatch.from_arrays(columns, names=["i", "range", "most", "least", "n", "ids", "weights"])


@dataclass(frozen=True)
class View:
    """The versions that a reader merges: the last base and what came after it, oldest first."""

    last: int
    versions: tuple[tuple[int, dict], ...] = ()

    @property
    def columns(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for _, entry in self.versions:
            out |= entry["columns"]
        return out


class Index:
    """A folder with a log of versions and one folder of data for each.

    A version holds the rows that a change put in, the keys that it put in or took out, and what is derived from its
    rows: a manifest of files, postings of words (`text` given) and blocks of sparse weights. What a change writes follows from
    the change, not from the index. A reader leaves out rows whose key a later version names. `compact` writes the live rows
    as a new base; a change does it by itself after MOST_DELTAS versions.

    A version appears with its entry in the log, which one writer alone can add. Of two changes at once the one that comes
    second is added after the other, its deletions worked out anew; with `expected` it raises Conflict instead. Data
    without an entry, left by a lost driver, are not read; `vacuum` removes them.

    Rows with equal keys have equal `by` (a chunk's id follows from its file). Rows are sorted by `by` within files, so that
    filters on it skip row groups. Columns of `optional` join the schema with the first rows that have them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, by: str = "file_path", key: str = "chunk_id", optional: str = SPARSE, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.by, self.key, self.most_deltas = spark, path.rstrip("/"), by, key, most_deltas
        self.schema = self._fields(schema)
        self.optional = self._fields(optional) if optional else {}
        self.log = VersionLog(spark, f"{self.path}/log")
        self.has_files = {"file_path", "source_sha", "chunk_id"} <= self.schema.keys() and key == "chunk_id"
        self.has_text = "text" in self.schema and key == "chunk_id"

    @staticmethod
    def _fields(ddl: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}

    # ------------------------------------------------------------ reading

    def view(self) -> View:
        """The present state; what is read by a view does not change with later versions."""
        last, found = self.log.last(), []
        for number in range(last, -1, -1):
            entry = self.log.read(number)
            found.append((number, entry))
            if entry["base"]:
                break
        return View(last, tuple(reversed(found)))

    def _columns(self, view: View) -> dict[str, str]:
        return self.schema | {c: t for c, t in view.columns.items() if c in self.optional}

    def _part(self, view: View, part: str, columns: dict[str, str], pick: Callable[[int], bool] = lambda v: True) -> DataFrame:
        """The rows of one part of all versions, with their version as `_v`."""
        out = None
        ddl = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        for number, entry in view.versions:
            if part in entry["parts"] and pick(number):
                one = self.spark.read.schema(ddl).parquet(f"{self.path}/data/{entry['parts'][part]}").withColumn("_v", F.lit(number))
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{ddl}, _v int")

    def _later_keys(self, view: View, after: int = -1) -> DataFrame | None:
        """key, _last: the last version that names a key, of the versions behind the base; None if they name none."""
        named = sum(e["keys"] for _, e in view.versions[1:])
        if not named:
            return None
        keys = self._part(view, "keys", {self.key: self._columns(view)[self.key]}, lambda v: v > max(after, view.versions[0][0]))
        return _sized(keys.groupBy(self.key).agg(F.max("_v").alias("_last")), named)

    def _live(self, rows: DataFrame, later: DataFrame | None, key: str | None = None) -> DataFrame:
        """`rows` (with _v) whose key no later version names."""
        if later is None:
            return rows
        key = key or self.key
        named = later.withColumnRenamed(self.key, key) if key != self.key else later
        return rows.join(named, key, "left").where(F.col("_last").isNull() | (F.col("_v") >= F.col("_last"))).drop("_last")

    def read(self, view: View | None = None) -> DataFrame:
        """All live rows."""
        view = view or self.view()
        columns = self._columns(view)
        return self._live(self._part(view, "rows", columns), self._later_keys(view)).select(*columns)

    def since(self, version: int, view: View | None = None) -> DataFrame:
        """The live rows that came after a version."""
        view = view or self.view()
        columns = self._columns(view)
        return self._live(self._part(view, "rows", columns, lambda v: v > version), self._later_keys(view)).select(*columns)

    def until(self, version: int, view: View | None = None) -> DataFrame:
        """The live rows without texts and vectors that were there at a version.

        A base that is newer counts as of its own version: what it holds is found by `since`.
        """
        view = view or self.view()
        columns = {c: t for c, t in self._columns(view).items() if c not in ("text", "window_text", "vector", *self.optional)}
        return self._live(self._part(view, "rows", columns, lambda v: v <= version), self._later_keys(view)).select(*columns)

    def manifest(self, view: View | None = None) -> DataFrame:
        """file_path, source_sha (of the last chunk by id), first_sha (of the first), n (chunks that the last version put in).

        It equals what a scan of the live rows finds and reads no row: a later version's chunk of the same id replaces the
        earlier one, and a deleted file's earlier versions are out. Files that left no chunk (`empty` of a change) follow,
        with their hash and n = 0, until they get chunks or are deleted.
        """
        held = self._entries(view or self.view()).groupBy("file_path")
        # An entry without chunks has null ids and comes behind those with chunks.
        return held.agg(F.max_by("last_sha", F.struct("last_id", "_v")).alias("source_sha"), F.min_by("first_sha", F.struct(F.col("first_id").isNull(), "first_id", -F.col("_v"))).alias("first_sha"), F.max_by("n", "_v").alias("n"))

    def _entries(self, view: View) -> DataFrame:
        """The manifest entries of all versions, without those of files that were deleted later."""
        entries = self._part(view, "files", {"file_path": "string", "first_id": "string", "first_sha": "string", "last_id": "string", "last_sha": "string", "n": "bigint"})
        if named := sum(e["gone"] for _, e in view.versions):
            gone = self._part(view, "gone", {"file_path": "string"}).groupBy("file_path").agg(F.max("_v").alias("_gone"))
            entries = entries.join(_sized(gone, named), "file_path", "left").where(F.col("_gone").isNull() | (F.col("_v") >= F.col("_gone"))).drop("_gone")
        return entries

    def _empty_files(self, view: View) -> DataFrame:
        """file_path, source_sha of the files that have no chunk."""
        return self._entries(view).groupBy("file_path").agg(F.max("last_id").alias("_last"), F.max_by("last_sha", "_v").alias("source_sha")).where(F.col("_last").isNull()).drop("_last")

    def file_shas(self, view: View | None = None) -> DataFrame:
        """file_path, source_sha of every file with a path, from the manifest."""
        return self.manifest(view).where("file_path <> ''").select("file_path", "source_sha")

    def lookup_sha(self, files: DataFrame, view: View | None = None) -> DataFrame:
        """file_path, source_sha of the wanted files, from the manifest: that of their first chunk by id, or the empty string."""
        held = self.manifest(view).select("file_path", "first_sha")
        return files.select("file_path").join(held, "file_path", "left").select("file_path", F.coalesce("first_sha", F.lit("")).alias("source_sha"))

    def point_count(self, view: View | None = None) -> DataFrame:
        """The number of live rows; only keys are read."""
        view = view or self.view()
        rows = self._part(view, "rows", {self.key: self._columns(view)[self.key]})
        return point_count(self._live(rows, self._later_keys(view)))

    def payload(self, view: View | None = None) -> DataFrame:
        """The live rows without texts and vectors."""
        return self.read(view).drop("text", "window_text", "vector", *self.optional)

    # ------------------------------------------------------------ postings

    def term_counts(self, wanted: Callable[[str], Column], view: View | None = None) -> DataFrame:
        """term, df: the number of live chunks with each word that `wanted` selects."""
        return self._counts("terms", "term_counts", "term", "string", wanted, view or self.view())

    def postings(self, wanted: Callable[[str], Column], view: View | None = None) -> DataFrame:
        """term, chunk_id of the live chunks with the words that `wanted` selects. Postings are sorted by word: others are skipped."""
        view = view or self.view()
        return self._live(self._part(view, "terms", {"term": "string", "chunk_id": "string"}).where(wanted("term")), self._later_keys(view)).select("term", "chunk_id")

    @property
    def has_sparse(self) -> bool:
        return any("blocks" in e["parts"] for _, e in self.view().versions)

    _BLOCK = {"i": "bigint", "range": "bigint", "most": "double", "least": "double", "n": "bigint"}

    def block_bounds(self, wanted: Callable[[str], Column], view: View | None = None) -> DataFrame:
        """i, v, range, most, least of the blocks that `wanted` selects by their index; no posting is read."""
        view = view or self.view()
        return self._part(view, "blocks", self._BLOCK).where(wanted("i")).select("i", F.col("_v").alias("v"), "range", "most", "least")

    def blocks(self, wanted: Callable[[str], Column], view: View | None = None) -> DataFrame:
        """i, v, range, chunk_id, w: the postings of the blocks that `wanted` selects, not yet told live from dead."""
        view = view or self.view()
        rows = self._part(view, "blocks", self._BLOCK | {"ids": "array<string>", "weights": "array<double>"}).where(wanted("i"))
        return rows.select("i", F.col("_v").alias("v"), "range", F.arrays_zip("ids", "weights").alias("z"))

    def live_postings(self, postings: DataFrame, view: View | None = None) -> DataFrame:
        """Rows of (v, chunk_id, ...) that no later version replaces."""
        later = self._later_keys(view or self.view())
        return postings if later is None else self._live(postings.withColumnRenamed("v", "_v"), later).withColumnRenamed("_v", "v")

    def sparse_counts(self, wanted: Callable[[str], Column], view: View | None = None) -> DataFrame:
        """i, df: the number of live chunks with each sparse index that `wanted` selects."""
        view = view or self.view()
        later = self._later_keys(view)
        stored = self._part(view, "blocks", self._BLOCK).where(wanted("i"))
        if later is None:
            return stored.groupBy("i").agg(F.sum("n").alias("df"))
        listed = self.blocks(wanted, view).select("i", "v", F.explode("z").alias("p")).select("i", "v", F.col("p.ids").alias("chunk_id"))
        return self.live_postings(listed, view).groupBy("i").agg(F.count("*").alias("df"))

    def _counts(self, part: str, counted: str, name: str, kind: str, wanted: Callable[[str], Column], view: View) -> DataFrame:
        later = self._later_keys(view)
        if later is None:
            return self._part(view, counted, {name: kind, "df": "bigint"}).where(wanted(name)).groupBy(name).agg(F.sum("df").alias("df"))
        rows = self._part(view, part, {name: kind, "chunk_id": "string"}).where(wanted(name))
        return self._live(rows, later).groupBy(name).agg(F.count("*").alias("df"))

    # ------------------------------------------------------------ writing

    def change(self, new: DataFrame | None = None, gone: DataFrame | None = None, key: str | None = None, expected: int | None = None, empty: DataFrame | None = None) -> int | None:
        """Take out the rows whose `by` is in `gone`, then put in those of `new`, in place of rows with the same key.

        `empty` (file_path, source_sha) are files that leave no chunk: the manifest knows them by their hash.

        Returns the number of the version, or None if there was nothing to do. With `expected`, the number of the last
        version that the caller has seen, a change that comes after another one raises Conflict.
        """
        if key not in (None, self.key):
            raise ValueError(f"the key of this index is {self.key}")
        folder, parts = uuid.uuid4().hex, {}
        columns = {}
        if new is not None:
            columns = self.schema | {c: t for c, t in self.optional.items() if c in new.columns}
            parts = self._write_rows(unique_by(new, self.key).select(*(F.col(c).cast(t) for c, t in columns.items())), columns, folder)
        if empty is not None:
            parts |= self._write_empty(empty, parts, folder)
        n_gone = self._save(gone.select(F.col(self.by).cast("string")).distinct(), f"{folder}/gone") if gone is not None else 0
        if n_gone:
            parts["gone"] = f"{folder}/gone"
        for attempt in range(100):
            view = self.view()
            if expected is not None and view.last != expected:
                raise Conflict(f"version {view.last} came after {expected}")
            n_keys = self._write_keys(view, parts, columns, n_gone, f"{folder}/keys-{attempt}")
            if not n_keys and not {"rows", "files"} & parts.keys() and not (n_gone and self._names_empty(view, parts["gone"])):
                return None
            entry = {"base": view.last < 0, "parts": parts | {"keys": f"{folder}/keys-{attempt}"}, "columns": columns or dict(self.schema), "keys": n_keys, "gone": n_gone}
            if self.log.add(view.last + 1, entry):
                if not entry["base"] and len(view.versions) >= self.most_deltas:
                    self.compact()
                return view.last + 1
        raise Conflict("other writers were first each time")

    def _save(self, rows: DataFrame, at: str) -> int:
        """Writes a part; the number of its rows."""
        rows.write.option("compression", CODEC).parquet(f"{self.path}/data/{at}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{at}").count()

    def _write_rows(self, rows: DataFrame, columns: dict[str, str], folder: str) -> dict[str, str]:
        """Rows and what is derived from them; the paths of the parts, none without rows."""
        # Rows stay where they are: an ingest run brings a file's chunks together, and a filter on `by` skips the pages of others in each task's file.
        if not self._save(rows.sortWithinPartitions(self.by), f"{folder}/rows"):
            return {}
        parts = {"rows": f"{folder}/rows"}
        rows = self.spark.read.schema(", ".join(f"`{c}` {t}" for c, t in columns.items())).parquet(f"{self.path}/data/{folder}/rows")

        def derive(part: str, made: DataFrame) -> DataFrame:
            # Ids come again and again in a file of postings: a large dictionary holds them once.
            made.write.option("compression", CODEC).option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(f"{self.path}/data/{folder}/{part}")
            parts[part] = f"{folder}/{part}"
            return self.spark.read.schema(made.schema).parquet(f"{self.path}/data/{folder}/{part}")

        if self.has_files:
            derive("files", file_entries(rows))
        # Postings are sorted in runs within the files of one task each: a look-up skips all pages but one or two of each run, and no posting is moved.
        if self.has_text:
            terms = derive("terms", text_postings(rows))
            derive("term_counts", terms.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term"))
        if "sparse_indices" in columns:
            derive("blocks", sparse_blocks(rows))
        return parts

    def _write_empty(self, empty: DataFrame, parts: dict[str, str], folder: str) -> dict[str, str]:
        """The manifest part, with the entries of files without chunks; none if there are none."""
        files = f"{folder}/files"
        none = F.lit(None).cast("string")
        entries = empty.select(F.col("file_path").cast("string"), none.alias("first_id"), F.col("source_sha").alias("first_sha"), none.alias("last_id"), F.col("source_sha").alias("last_sha"), F.lit(0).cast("bigint").alias("n"))
        entries.write.mode("append").option("compression", CODEC).parquet(f"{self.path}/data/{files}")
        if "files" in parts or not self.spark.read.schema("n bigint").parquet(f"{self.path}/data/{files}").isEmpty():
            return {"files": files}
        return {}

    def _names_empty(self, view: View, at: str) -> bool:
        """Whether a deletion names a file without chunks."""
        gone = self.spark.read.schema(f"`{self.by}` string").parquet(f"{self.path}/data/{at}")
        return self.has_files and self.by == "file_path" and not self._empty_files(view).join(gone, "file_path", "left_semi").isEmpty()

    def _write_keys(self, view: View, parts: dict[str, str], columns: dict[str, str], n_gone: int, at: str) -> int:
        """The keys that a change names: those that it puts in and those of the live rows that it takes out."""
        kind = (self.schema | columns)[self.key]
        keys = self.spark.createDataFrame([], f"`{self.key}` {kind}")
        if "rows" in parts:
            keys = self.spark.read.schema(f"`{self.key}` {kind}").parquet(f"{self.path}/data/{parts['rows']}")
        if n_gone:
            gone = self.spark.read.schema(f"`{self.by}` string").parquet(f"{self.path}/data/{parts['gone']}")
            held = self._part(view, "rows", {self.key: kind, self.by: self._columns(view)[self.by]}).join(_sized(gone, n_gone), self.by, "left_semi")
            keys = keys.unionByName(self._live(held, self._later_keys(view)).select(self.key))
        return self._save(keys.distinct(), at)

    def upsert(self, new: DataFrame, key: str | None = None) -> int | None:
        return self.change(new, key=key)

    def delete_files(self, files: DataFrame) -> int | None:
        return self.change(gone=files)

    def compact(self) -> bool:
        """Write the live rows as a new base. False, and nothing changed, if another version came meanwhile."""
        view = self.view()
        if not view.versions:
            return True
        columns = self._columns(view)
        folder = uuid.uuid4().hex
        parts = self._write_rows(self.read(view), columns, folder)
        if self.has_files:
            parts |= self._write_empty(self._empty_files(view), parts, folder)
        return self.log.add(view.last + 1, {"base": True, "parts": parts, "columns": columns, "keys": 0, "gone": 0})

    def vacuum(self, older_than_seconds: float = 7 * 86400) -> int:
        """Remove the data of versions before the base, and of changes that did not come to an end, if they are so old; their number.

        Readers of earlier views and changes under way need their data: the age has to exceed how long they last.
        """
        view = self.view()
        kept = {p.split("/")[0] for _, e in view.versions for p in e["parts"].values()}
        if view.versions:
            self.log.forget(view.versions[0][0], older_than_seconds)
        path = self.log._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        old = [s for s in self.log._fs.listStatus(path) if s.getPath().getName() not in kept and s.getModificationTime() / 1000 <= time.time() - older_than_seconds] if self.log._fs.exists(path) else []
        for s in old:
            self.log._fs.delete(s.getPath(), True)
        return len(old)
