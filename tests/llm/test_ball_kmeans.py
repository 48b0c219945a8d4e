"""Ball k-means against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from siftmill.llm import ball_kmeans as bk


def plain_kmeans(rows, k, rounds, dimension, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        cents = [[sum(x) // len(m) for x in zip(*m, strict=True)] if (m := [v for (_, v), c in zip(kept, of, strict=True) if c == j]) else cents[j] for j in range(len(cents))]
    done = [(i, *nearest(v)[::-1]) for i, v in kept]
    top = 2**63 - 1
    total = sum(min(d, top) for *_, d in done)
    by = {j: sum(min(d, top) for _, c, d in done if c == j) for j in range(len(cents))}
    return sorted(((i is None, i or 0), c, min(d, top), min(by[c], top), min(total, top), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in done)


def run(spark, rows, k=4, rounds=3, dimension=3, scale=64):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, cells string").repartition(3)
    got = bk.ball_kmeans(df, k, rounds, dimension, scale).collect()
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def floats(rng, spread, n):
    return [[float(np.float32(rng.uniform(-spread, spread))) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.05, 2.0, 3000.0, 1e9, 1e30])
def test_equals_plain_rounds(spark, spread):
    rng = random.Random(int(spread))
    rows = [(k, v) for k, v in enumerate(floats(rng, spread, 80))]
    assert run(spark, rows) == plain_kmeans(rows, 4, 3, 3, 64)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, v) for k, v in enumerate(floats(rng, 1.0, 30))]
    rows += [(None, [0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5]), (3, [1.0, 1.0, 1.0]), (50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 0.0]), (54, [float("nan"), 0.0, 0.0]), (55, [float("inf"), 0.0, 0.0]), (56, [0.0] * 4)]
    rows += [(60, [0.1, 0.2, 0.3])] * 100
    assert run(spark, rows) == plain_kmeans(rows, 4, 3, 3, 64)


def test_equal_and_empty_centroids(spark):
    rows = [(k, [0.5, 0.5, 0.5]) for k in range(9)]
    got = run(spark, rows)
    assert got == plain_kmeans(rows, 4, 3, 3, 64)
    assert {r[1] for r in got} == {0}


def test_few_rows_and_none(spark):
    assert run(spark, [(1, [1.0, 2.0, 3.0])]) == plain_kmeans([(1, [1.0, 2.0, 3.0])], 4, 3, 3, 64)
    assert run(spark, [(1, None)]) == []


def test_members_are_compared_with_relevant_neighbours_only(monkeypatch):
    rng = np.random.default_rng(1)
    cents = [[100 * k, 0, 0] for k in range(8)]
    rows = np.concatenate([np.array(c) + rng.integers(-20, 21, (50, 3)) for c in cents]).astype(np.float64)
    cluster = np.repeat(np.arange(8), 50).astype(np.int32)
    balls = bk.Balls.of(cents, [40.0] * 8)
    assert all(not n for n in balls.near)
    wide = bk.Balls.of(cents, [60.0] * 8)
    assert wide.near[0] == [1] and sorted(wide.near[3]) == [2, 4]
    compared = []
    plain = bk.squared
    monkeypatch.setattr(bk, "squared", lambda r, c: compared.append(len(r)) or plain(r, c))
    new, best = bk.Balls.of(cents, None).assign(rows, cluster)
    assert np.array_equal(new, cluster) and sum(compared) < 2 * len(rows) and (best <= 1200).all()


def test_ties_on_the_middle_go_to_the_smaller_number():
    balls = bk.Balls.of([[0, 0], [4, 0], [8, 0]], [2.0, 2.0, 2.0])
    new, best = balls.assign(np.array([[2.0, 0.0], [2.0, 0.0], [6.0, 0.0]]), np.array([0, 1, 2], np.int32))
    assert new.tolist() == [0, 0, 1] and best.tolist() == [4, 4, 4]
