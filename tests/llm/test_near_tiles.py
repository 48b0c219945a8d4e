"""Near duplicates where leaders, buckets and families are dealt in several parts, and their forests and components."""

import random

import numpy as np
import pytest

from siftmill.llm import near_dedup

from .test_kernels_and_edges import brute_near, frame


def family(seed, n):
    """Texts that differ from one base in some of 60 words: similar, but far from all of them linked."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in draw.sample(range(60), draw.choice([0, 1, 1, 2, 2, 3])):
            text[at] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("tile", [3, 1000])
def test_tiles_and_salts_change_nothing(spark, tile):
    texts = family(1, 45) + family(2, 15) + [None, "", "short one"] + family(1, 3)
    got = near_dedup.near_duplicates(frame(spark, texts), 4, leader_share=tile, bucket_tile=tile, family_tile=tile).collect()
    want = brute_near(texts, list(range(len(texts))), 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert len({c for _, c, _ in want.values()}) > 5


@pytest.mark.parametrize(("seed", "task"), [(0, 20), (1, 60), (2, 10_000)])
def test_components_equal_union_find(spark, seed, task):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(450, 500)]
    joined = near_dedup.Joined()
    for a, b in edges:
        joined.new(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    smallest = {}
    for x in sorted(nodes):
        smallest.setdefault(joined.root(x), x)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that no task sees all edges
    try:
        got = near_dedup.components(spark.createDataFrame(edges * 2, "p long, q long"), "p", "q", task_edges=task).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["id"]: r["component"] for r in got} == {x: smallest[joined.root(x)] for x in nodes} and len(got) == len(nodes)


def test_components_without_links(spark):
    assert near_dedup.components(spark.createDataFrame([], "p long, q long"), "p", "q").collect() == []


def test_forest_spans_what_is_near():
    near = np.random.default_rng(3).random((80, 80)) < 0.02
    near |= near.T
    joined, parts = near_dedup.Joined(), near_dedup.Joined()
    for a, b in zip(*np.nonzero(near), strict=True):
        joined.new(int(a), int(b))
    edges = near_dedup.forest(80, lambda rows, others: near[np.ix_(rows, others)])
    assert all(near[a, b] and parts.new(a, b) for a, b in edges)
    assert len({joined.root(k) for k in range(80)}) == len({parts.root(k) for k in range(80)}) == 80 - len(edges)


def test_a_full_register_only_forgets():
    joined = near_dedup.Joined(most=4)
    assert [joined.new(a, b) for a, b in [(1, 2), (3, 4), (1, 2), (5, 6), (1, 2)]][:3] == [True, True, False]
