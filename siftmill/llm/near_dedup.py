"""MinHash near-duplicate detection with circulant signatures, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import durable, small
from siftmill.llm.kernels import chunks, mix64, shingle_sets, text_column, word_hashes

#: A pair with similarity 0.8 shares none of 40 bands of 5 coordinates with probability (1 - 0.8**5)**40 = 1.2e-7.
BANDS, ROWS = 40, 5
#: Bits of the 192-bit sketch in which a pair of similarity 0.8 differs: 19.2 on average, over 45 with probability 1e-8.
SKETCH_WORDS, SKETCH_DIFF = 3, 45
#: Members that one copy of a leader's set is compared with; rows of a bucket, and texts of a family and their shingles, in one tile.
LEADER_SHARE, BUCKET_TILE, FAMILY_TILE, TILE_SHINGLES = 500, 1024, 400, 200_000
#: Edges that one task of a component search holds.
TASK_EDGES = 50_000
#: Entries of the largest temporary array of a task: comparisons are made in blocks of so many.
BLOCK_ENTRIES = 1 << 19

SIGNATURE = "doc_id long, n long, fp1 long, fp2 long, s0 long, s1 long, s2 long, bands array<long>"


def permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """C-MinHash: coordinate k of a set is min over its items v of pi((sigma(v) + k * stride) mod 2**32).

    Two permutations serve all coordinates: sigma breaks up the structure of the items, and pi is shifted around the
    circle of 2**32 places. Empty sets get no row.
    """
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    base = permute((items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(sets), size), np.uint32)
    work = np.empty_like(base)
    for k in range(size):
        np.add(base, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=work)
        out[:, k] = np.minimum.reduceat(permute(work, 0x21F0AAAD, 0x735A2D97), starts)
    return out


def signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """Per row: set size, 128-bit fingerprint of the set, band hashes and a one-bit-per-coordinate sketch."""
    names = [x.split()[0] for x in SIGNATURE.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column(1))
            for lo, hi, part, starts in chunks(data, offsets, 1 << 18):
                sets = shingle_sets(*word_hashes(part, starts), width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                prints, sketch, bands = np.zeros((2, hi - lo), np.uint64), np.zeros((3, hi - lo), np.uint64), np.zeros((hi - lo, BANDS), np.uint64)
                if len(full):
                    some = [sets[i] for i in full]
                    begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    items = np.concatenate(some)
                    prints[0, full] = np.add.reduceat(mix64(items ^ np.uint64(0x51ED270B)), begin)
                    prints[1, full] = np.add.reduceat(mix64(items * np.uint64(0xD6E8FEB86659FD93)), begin)
                    sig = circulant_signatures(some, BANDS * ROWS)
                    folded = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()
                    for r in range(ROWS):
                        folded = mix64(folded * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
                    bands[full] = folded
                    bits = np.packbits((sig[:, : 64 * SKETCH_WORDS] & 1).astype(np.uint8), axis=1)
                    sketch[:, full] = bits.view(np.uint64).T
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(x.view(np.int64)) for x in (*prints, *sketch))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*arrays, lists], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(each, SIGNATURE)


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, key: str, text: str, share: int = LEADER_SHARE) -> DataFrame:
    """The pairs (lead, member) whose full shingle sets satisfy 100 * intersection >= percent * union.

    Texts travel once to each leader that they are compared with. A leader with more than `share` members is copied to
    several tasks, so that no task gets a group that grows with the data; in a task, a leader's text comes before its members.
    """
    counts = durable(pairs.groupBy("lead").agg(F.ceil(F.count("*") / share).cast("int").alias("salts")))
    # One salt needs no lookup; the leaders with more are at most a `share`-th of the pairs.
    dealt = pairs.join(small(counts.where("salts > 1")), "lead", "left").withColumn("salt", F.pmod(F.xxhash64("member"), F.coalesce("salts", F.lit(1))).cast("int"))
    leads = counts.select(F.col("lead").alias("id"), "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = leads.unionByName(dealt.select(F.col("member").alias("id"), "lead", "salt", F.lit(1).alias("role")))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    sent = texts.join(wanted, "id").select("lead", "salt", "role", "id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            data, offsets = text_column(batch.column(4))
            lead, salt, role, ident = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for lo, _, part, starts in chunks(data, offsets, 1 << 18):
                for k, items in enumerate(shingle_sets(*word_hashes(part, starts), width), lo):
                    if (lead[k], salt[k]) != at:
                        at, own = (lead[k], salt[k]), []
                    if role[k] == 0:
                        own.append(items)
                    elif any(100 * (both := len(np.intersect1d(x, items, assume_unique=True))) >= percent * (len(x) + len(items) - both) for x in own):
                        out.append((lead[k], ident[k]))
            columns = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["lead", "member"])

    return sent.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role").mapInArrow(compare, "lead long, member long")


class Joined:
    """Disjoint sets of ids, whose roots are their smallest members: tells which edges connect what earlier ones did not.

    Forgets everything when it holds `most` ids, so that a task's memory is bounded.
    """

    def __init__(self, most: int = 500_000):
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def new(self, a: int, b: int) -> bool:
        if len(self.up) > self.most:
            self.up.clear()
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _stars(edges: DataFrame) -> DataFrame:
    """(id, root): in each partition of (x, y), every id beside the smallest one that it reaches there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()

        def out() -> pa.RecordBatch:
            ids = list(joined.up)
            roots = [joined.root(x) for x in ids]
            joined.up.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                joined.new(a, b)
                if len(joined.up) >= joined.most:
                    yield out()
        yield out()

    return edges.mapInArrow(each, "id long, root long")


def _jump(parents: DataFrame) -> DataFrame:
    # Tables of ids grow with the documents: merged by sorting, also while they are small, they cost the driver nothing.
    return parents.hint("merge").join(parents.select(F.col("id").alias("root"), F.col("root").alias("far")), "root").select("id", F.col("far").alias("root"))


def _roots(parents: DataFrame) -> DataFrame:
    """id, root for a table (id, root) of parents with smaller ids: each row follows its parents, four steps at a time."""
    while True:
        parents = durable(_jump(_jump(parents)))
        far = parents.select(F.col("id").alias("root"), F.col("root").alias("far"))
        if not parents.hint("merge").join(far, "root").where("far < root").limit(1).count():
            return parents


def components(links: DataFrame, a: str, b: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """id, component: the smallest id reachable over the links, by contraction.

    Tasks of about `task_edges` edges lead each id to the smallest one that it reaches there. Then every id follows these
    down to a local minimum, and the edges between minima are what the next round sees: loops and doubles leave. The last
    round is the one whose edges fit a single task.
    """
    edges = durable(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y").distinct())
    labels = None
    while True:
        parts = max(1, -(-edges.count() // task_edges))
        stars = durable(_stars(edges.coalesce(parts)))
        roots = stars if parts == 1 else _roots(durable(stars.groupBy("id").agg(F.min("root").alias("root"))))
        if labels is None:
            labels = roots.select("id", F.col("root").alias("component"))
        else:
            now = roots.select(F.col("id").alias("component"), "root")
            labels = labels.join(now, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        if parts == 1:
            return durable(labels)
        near, far = roots.select("id", F.col("root").alias("a")), roots.select(F.col("id").alias("root"), F.col("root").alias("b"))
        between = stars.where("id > root").hint("merge").join(near, "id").hint("merge").join(far, "root")
        edges = durable(between.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct())


def differing_bits(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))


def plausible(sketch: np.ndarray, size: np.ndarray, component: np.ndarray, rows: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which (row, other) lie in different components and may be similar by size and sketch."""
    bits = np.zeros((len(rows), len(others)), np.uint8)
    for k in range(sketch.shape[1]):
        bits += np.bitwise_count(sketch[rows, k][:, None] ^ sketch[others, k][None, :])
    n, m = size[rows][:, None], size[others][None, :]
    near = bits <= SKETCH_DIFF
    near &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    near &= component[rows][:, None] != component[others][None, :]
    return near


def forest(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that `near` tells in blocks: each row is expanded once."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, BLOCK_ENTRIES // len(left))
            rows, front = front[:step], front[step:]
            hit = near(rows, left)
            new = hit.any(axis=0)
            edges += zip(rows[hit.argmax(axis=0)[new]].tolist(), left[new].tolist(), strict=True)
            front, left = np.concatenate([front, left[new]]), left[~new]
    return edges


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of neighbouring rows that agree in the first `keys` columns, across the batches of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _tiled(rows: DataFrame, group: str, tiles: str) -> DataFrame:
    """Rows with (i, j) for each pair of tiles of their group that they belong to: a tile holds a bounded number of rows."""
    placed = rows.withColumn("_t", F.pmod(F.xxhash64("id"), F.col(tiles)).cast("int")).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col(tiles).cast("int") - 1)))
    return placed.withColumns({"i": F.least("_t", "_u"), "j": F.greatest("_t", "_u")}).drop("_t", "_u", tiles)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs, strict=True) if pairs else ([], []))], schema=_EDGE)


def families(labelled: DataFrame, crowded: DataFrame, percent: int, bucket_tile: int = BUCKET_TILE) -> DataFrame:
    """id, family: groups outside which no links between components can be.

    In each band bucket with several components, rows of different components whose sketches allow 80 % are joined to
    families. Of the pairs of a task only a spanning forest leaves it; large buckets are dealt in tiles.
    """
    here = crowded.join(labelled.select("id", "component"), "id")
    counted = here.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.ceil(F.count("*") / bucket_tile).alias("tiles"))
    mixed = durable(counted.where("_lo < _hi").select("band", "tiles"))
    inside = crowded.join(mixed, "band").join(labelled, "id")
    dealt = _tiled(inside, "band", "tiles").select("band", "i", "j", "id", "component", "n", "s0", "s1", "s2")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, out = Joined(), []
        for group in runs(batches, 3):
            ids, component, size, *words = (group.column(k).to_numpy() for k in range(3, 9))
            sketch = np.stack(words, axis=1).view(np.uint64)
            found = ((int(ids[x]), int(ids[y])) for x, y in forest(len(ids), lambda r, o: plausible(sketch, size, component, r, o, percent)))  # noqa: B023
            out += [e for e in found if joined.new(*e)]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    loose = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(each, "a long, b long")
    return components(loose, "a", "b").withColumnRenamed("component", "family")


def family_links(docs: DataFrame, members: DataFrame, width: int, percent: int, key: str, text: str, family_tile: int = FAMILY_TILE) -> DataFrame:
    """A spanning forest (a, b) of the links between different components of a family, found on full sets.

    A family's texts meet in tiles of a bounded number of texts and shingles; intersections are counted by products of the
    tile's membership matrix, a slice of its shingles at a time.
    """
    wanted = F.greatest(F.ceil(F.count("*") / family_tile), F.ceil(F.sum("n") / TILE_SHINGLES))
    tiled = _tiled(members.join(durable(members.groupBy("family").agg(wanted.alias("tiles"))), "family"), "family", "tiles")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    sent = texts.join(tiled, "id").select("family", "i", "j", "id", "component", "n", "s0", "s1", "s2", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for group in runs(batches, 3):
            ids, component, size, *words = (group.column(k).to_numpy() for k in range(3, 9))
            sketch = np.stack(words, axis=1).view(np.uint64)
            every = np.arange(len(ids))
            may = plausible(sketch, size, component, every, every, percent)
            some = np.flatnonzero(may.any(axis=0))
            if not len(some):
                continue
            ids, may = ids[some], may[np.ix_(some, some)]
            data, offsets = text_column(group.column(9).combine_chunks().take(pa.array(some)))
            sets = [s for _, _, part, starts in chunks(data, offsets, 1 << 18) for s in shingle_sets(*word_hashes(part, starts), width)]
            linked = np.zeros(may.shape, bool)
            size = np.array([len(s) for s in sets])
            both = np.zeros(may.shape, np.float32)
            items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(items)
            items, owner = items[order], owner[order]
            column = np.cumsum(np.concatenate([[0], items[1:] != items[:-1]]))
            cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1, 2048)) if len(items) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(items)], strict=True):
                member = np.zeros((len(sets), 2048), np.float32)
                member[owner[lo:hi], column[lo:hi] % 2048] = 1
                both += member @ member.T
            linked = may & (100 * both >= percent * (size[:, None] + size[None, :] - both))
            found = ((int(ids[x]), int(ids[y])) for x, y in forest(len(ids), lambda r, o: linked[np.ix_(r, o)]))  # noqa: B023
            yield _edges([e for e in found if joined.new(*e)])

    return sent.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(each, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
    leader_share: int = LEADER_SHARE,
    bucket_tile: int = BUCKET_TILE,
    family_tile: int = FAMILY_TILE,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    A document's set holds the distinct shingles of `width` A-Z-folded words; with fewer words, the whole sequence is
    one; null and empty texts have none and are linked with nothing. Two documents are linked where 100 * intersection
    >= percent * union; component_id is the smallest key reachable over links, and kept marks the rows that carry it.
    percent is at least 80: the bands are chosen for that. Rows with the same key count as one document. A row with a
    null key is linked with nothing: its component_id is null and it is kept. An empty table gives no rows.

    Rows with equal sets become one node. In every band bucket each node is compared with the smallest one only, and
    links are closed to components. Then rows of different components that share a bucket, and whose sketches allow 80 %,
    form families, in which all of them are compared on full sets, so that no link between different texts is lost.
    Pairs are formed inside tasks; what leaves a task is a spanning forest. `leader_share`, `bucket_tile` and `family_tile`
    bound what one task compares; they change no result. A very long text is hashed whole.
    """
    if percent < 80:
        raise ValueError("the bands find pairs of 80 % and more")
    rows = durable(signatures(docs, width, key, text))
    keyed = rows.where("n > 0 and doc_id is not null")
    reps = durable(keyed.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")))
    nodes = durable(keyed.join(reps.withColumnRenamed("rep", "doc_id"), ["fp1", "fp2", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "s0", "s1", "s2", "bands"))
    banded = nodes.select("id", F.explode("bands").alias("band"))
    shared = durable(banded.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("band", "lead"))
    crowded = durable(banded.join(shared, "band").select("band", "id", "lead"))
    stars = crowded.where("id <> lead").select("lead", F.col("id").alias("member")).distinct()
    crowded = crowded.select("band", "id")
    brief = nodes.select("id", "n", "s0", "s1", "s2")

    def likely(left: str, right: str) -> Column:
        n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differing_bits(left, right) <= SKETCH_DIFF)

    tried = durable(stars.join(brief.alias("a"), F.col("lead") == F.col("a.id")).join(brief.alias("b"), F.col("member") == F.col("b.id")).where(likely("a", "b")).select("lead", "member"))
    links = durable(verified(docs, tried, width, percent, key, text, leader_share))
    found = components(links, "lead", "member")

    labelled = durable(brief.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    kin = families(labelled, crowded, percent, bucket_tile)
    if kin.limit(1).count():
        rest = durable(family_links(docs, durable(kin.join(labelled, "id")), width, percent, key, text, family_tile))
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest), "a", "b")
    ends = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    done = keyed.select("doc_id", "n", "fp1", "fp2").join(ends, ["fp1", "fp2"])
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = done.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
