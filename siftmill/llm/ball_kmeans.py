"""Ball k-means: exact Lloyd rounds in which a vector is compared only with centroids that could be nearer.

A cluster is a ball: its centroid and a radius that no member exceeds. With the distances D between centroids, a centroid j
can take members of ball i only if D(i, j) / 2 is at most the radius: these are the neighbours of i. Sorted by distance,
their half distances cut the ball into a stable core (nearer to i than half the way to any neighbour: it stays without a
comparison) and annuli; a member of the m-th annulus is compared with the m nearest neighbours alone. All of it holds in
integers: with squared distances, centroid j matters to x of ball i only if 4 d2(x, i) >= D2(i, j); equality counts, as it may be a
tie that the smaller number wins.

A pass over the vectors assigns, and returns each cluster's count, sums and largest squared distance: k rows a task, merged
in a few tasks and then on the driver, which holds k centroids. A centroid's move widens the radius of the next round, so
that radii need no pass of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import durable

#: Components below this, as a double holds sums of 64 products of two such numbers and more; beyond it, Python's integers.
EXACT = 1 << 20
#: Tasks that merge what the tasks of a pass found; each hands k rows to the driver.
MERGERS = 16
MOST_LONG = 2**63 - 1

STATE = "vec_id long, cells binary, cluster int, distance long"
FOUND = "cluster int, n long, sums array<string>, most long, total string"


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector has exactly `dimension` components, none of them null, infinite or not a number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dimension) & fine, F.lit(False))


def grid_cells(column: pa.Array, dimension: int, scale: int) -> list[bytes]:
    """floor(scale * x) of each component: signed integers of 1, 2, 4 or 8 bytes, or decimal text where they need more."""
    values = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension) * scale)
    out: list[bytes] = [b""] * len(values)
    most = np.abs(values).max(axis=1, initial=0)
    left = np.ones(len(values), bool)
    for kind, limit in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**62)):
        at = np.flatnonzero(left & (most < limit))
        left[at] = False
        for k, row in zip(at.tolist(), values[at].astype(kind), strict=True):
            out[k] = row.tobytes()
    for k in np.flatnonzero(left).tolist():
        text = ",".join(str(int(x)) for x in values[k]).encode()
        out[k] = text + b" " * (len(text) % dimension == 0)  # told from integers by its length
    return out


def cells_of(raw: list[bytes], dimension: int) -> np.ndarray:
    """Rows of integers: doubles where all are below EXACT, else objects that hold Python's integers."""
    wide: dict[int, list[int]] = {}
    for k, b in enumerate(raw):
        wide.setdefault(0 if len(b) % dimension else len(b) // dimension, []).append(k)
    if wide.keys() <= {1, 2, 4}:
        out = np.zeros((len(raw), dimension))
        for w, at in wide.items():
            out[at] = np.frombuffer(b"".join([raw[k] for k in at]), f"<i{w}").reshape(len(at), dimension)
        if np.abs(out).max(initial=0) < EXACT:
            return out
    rows = np.empty((len(raw), dimension), object)
    for w, at in wide.items():
        for k in at:
            rows[k] = [int(x) for x in raw[k].split(b",")] if w == 0 else np.frombuffer(raw[k], f"<i{w}").tolist()
    return rows


def squared(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    if rows.dtype != object and max(map(abs, centroid), default=0) < EXACT:
        gap = rows - np.array(centroid, np.float64)
        return np.einsum("ij,ij->i", gap, gap)
    gap = rows.astype(object) if rows.dtype == object else rows.astype(np.int64).astype(object)
    gap = gap - np.array(centroid, object)
    return (gap * gap).sum(axis=1)


@dataclass
class Balls:
    """The clusters of a round: centroids, and for each the centroids near enough to take its members.

    near[i]: numbers of the neighbours of ball i by distance; gaps[i]: their squared distances. Without radii, as in the
    first round, all others are neighbours.
    """

    centroids: list[list[int]]
    near: list[list[int]]
    gaps: list[list[int]]

    @classmethod
    def of(cls, centroids: list[list[int]], radii: list[float] | None) -> Balls:
        near, gaps = [], []
        for i, c in enumerate(centroids):
            far = sorted((sum((a - b) ** 2 for a, b in zip(c, d, strict=True)), j) for j, d in enumerate(centroids) if j != i)
            # The radius is a bound from above, with some room for rounding.
            reach = math.inf if radii is None else 4 * radii[i] ** 2 * (1 + 1e-9)
            found = [(d, j) for d, j in far if d <= reach]
            near.append([j for _, j in found])
            gaps.append([d for d, _ in found])
        return cls(centroids, near, gaps)

    def assign(self, rows: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (ties: smaller number) and its squared distance, from its ball so far."""
        new = cluster.copy()
        best = np.zeros(len(rows), rows.dtype)
        for i in np.unique(cluster).tolist():
            at = np.flatnonzero(cluster == i)
            own = squared(rows[at], self.centroids[i])
            if own.dtype == object and best.dtype != object:
                best = best.astype(object)
            low, to = own.copy(), np.full(len(at), i)
            # The annulus of each member: so many neighbours matter to it. 0 is the stable core.
            gaps = np.array(self.gaps[i], object)
            annulus = np.searchsorted(gaps, 4 * own, "right") if own.dtype == object else np.searchsorted(gaps.astype(np.float64), 4 * own * (1 + 1e-12), "right")
            for m, j in enumerate(self.near[i]):
                some = np.flatnonzero(annulus > m)
                if not len(some):
                    break
                d = squared(rows[at[some]], self.centroids[j])
                if d.dtype == object and low.dtype != object:
                    low = low.astype(object)
                wins = (d < low[some]) | ((d == low[some]) & (j < to[some]))
                low[some[wins]], to[some[wins]] = d[wins], j
            if low.dtype == object and best.dtype != object:
                best = best.astype(object)
            new[at], best[at] = to, low
        return new, best


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array([min(x, MOST_LONG) for x in values.tolist()] if values.dtype == object else values.astype(np.int64), pa.int64())


def _pass(state: DataFrame, balls: Balls, dimension: int) -> DataFrame:
    """Every vector assigned anew."""
    shared = state.sparkSession.sparkContext.broadcast(balls)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = shared.value.assign(cells_of(batch.column(1).to_pylist(), dimension), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), _longs(distance)], names=["vec_id", "cells", "cluster", "distance"])

    return state.mapInArrow(each, STATE)


def _merged(rows: Iterator[tuple[int, int, list[int], int, int]]) -> dict[int, tuple[int, list[int], int, int]]:
    out: dict[int, tuple[int, list[int], int, int]] = {}
    for cluster, n, sums, most, total in rows:
        m = out.get(cluster)
        out[cluster] = (n, list(sums), most, total) if m is None else (m[0] + n, [a + b for a, b in zip(m[1], sums, strict=True)], max(m[2], most), m[3] + total)
    return out


def _found(merged: dict[int, tuple[int, list[int], int, int]]) -> pa.RecordBatch:
    rows = [(c, n, [str(x) for x in sums], most, str(total)) for c, (n, sums, most, total) in sorted(merged.items())]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["cluster", "n", "sums", "most", "total"])


def totals(state: DataFrame, dimension: int) -> dict[int, tuple[int, list[int], int, int]]:
    """Of each cluster with members: their number, the sums of their components, their largest and summed squared distance.

    A task hands on one row a cluster, and MERGERS tasks hand k rows each to the driver.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, int, list[int], int, int]]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, cluster = cells_of(batch.column(0).to_pylist(), dimension), batch.column(1).to_numpy()
                distance = batch.column(2).to_numpy()
                for c in np.unique(cluster).tolist():
                    at = cluster == c
                    yield c, int(at.sum()), [int(x) for x in rows[at].sum(axis=0)], int(distance[at].max()), sum(distance[at].tolist())

        yield _found(_merged(parts()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _found(_merged((r["cluster"], r["n"], [int(x) for x in r["sums"]], r["most"], int(r["total"])) for b in batches for r in b.to_pylist()))

    found = state.select("cells", "cluster", "distance").mapInArrow(each, FOUND).repartition(MERGERS).mapInArrow(merge, FOUND)
    return _merged((r["cluster"], r["n"], [int(x) for x in r["sums"]], r["most"], int(r["total"])) for r in found.collect())


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Vectors with null, infinite or missing components, or of another length, are left out; the others become
    floor(scale * x), exact whatever their size (squared distances and their sums beyond a long are shown as the largest
    long). The first centroids are the k vectors with the smallest SHA-256 of `1:<key>` (a null key is empty), equal ones in
    the order of their components; fewer vectors give fewer centroids. Each round assigns and replaces centroids by the floor of their
    members' means; empty ones stay. Repeated rows count as often as they occur; equal centroids are told apart by their
    numbers. An empty table gives no rows; other columns are left out.
    """

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grid_cells(batch.column(1), dimension, scale), pa.binary())], names=["vec_id", "cells"])

    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v"), dimension))
    first = kept.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "vec_id", "v").orderBy("h", "v").limit(k)
    starts = first.select("vec_id", "v").mapInArrow(to_cells, "vec_id long, cells binary")
    centroids = [[int(x) for x in cells_of([bytes(r["cells"])], dimension)[0]] for r in starts.collect()]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    state = kept.mapInArrow(to_cells, "vec_id long, cells binary").select("vec_id", "cells", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    state = durable(_pass(state, Balls.of(centroids, None), dimension))
    for _ in range(rounds):
        found = totals(state, dimension)
        moved = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
        radii = [(math.sqrt(found[c][2]) if found[c][2] < MOST_LONG else math.inf) + math.sqrt(sum((a - b) ** 2 for a, b in zip(moved[c], centroids[c], strict=True))) if c in found else 0.0 for c in range(len(centroids))]
        centroids = moved
        state = durable(_pass(state, Balls.of(centroids, radii), dimension))
    found = totals(state, dimension)
    whole = min(sum(total for *_, total in found.values()), MOST_LONG)
    said = [(c, min(total, MOST_LONG), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, (*_, total) in sorted(found.items())]
    of = vectors.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
