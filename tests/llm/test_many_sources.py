"""Targets of many sources, numbered in several ranges, against plain rounds of resharing."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siftmill.llm import mixing


def plain(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, capped = Fraction(sum(sizes.values()) * share[0], share[1]), set()
    while True:
        rest = [s for s in order if s not in capped]
        level = (budget - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if w[s] * level > most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s]) if s in capped else float(w[s] * level) for s in order}
        capped |= more


@pytest.mark.parametrize(("rows", "seed", "share"), [(7, 1, (3, 2)), (1000, 2, (3, 2)), (13, 3, (2, 1)), (5, 4, (1, 10))])
def test_targets_of_many_sources(spark, monkeypatch, rows, seed, share):
    monkeypatch.setattr(mixing, "SOURCE_ROWS", rows)
    rng = random.Random(seed)
    sizes = {rng.choice("abéz\U0001f600") + str(k): int(rng.paretovariate(0.7)) for k in range(60)} | {None: 40, "": 7, "none": 0}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(table, [3, 1, 2], share, 2).collect()}
    assert got == pytest.approx(plain(sizes, [3, 1, 2], share, 2))
    numbers = {r["source"]: r["_i"] for r in mixing.numbered_sources(table).collect()}
    assert sorted(numbers, key=numbers.get) == sorted(sizes, key=lambda s: (s is None, s or "")) and sorted(numbers.values()) == list(range(63))


def test_no_words_and_no_sources(spark):
    table = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")
    assert {r["target"] for r in mixing.source_targets(table, [1], (3, 2), 2).collect()} == {0.0}
    assert mixing.source_targets(table.where(F.lit(False)), [1], (3, 2), 2).count() == 0
