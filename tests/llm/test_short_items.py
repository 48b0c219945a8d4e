"""Benchmark items of fewer words than a window."""

from collections import Counter
from itertools import combinations

import numpy as np

from siftmill.llm import decontaminate

from .test_kernels_and_edges import frame


def test_seeds_of_every_length_meet_every_allowed_substitution():
    for length in range(1, decontaminate.SPAN + 1):
        most = length * (decontaminate.SPAN - decontaminate.MIN_MATCH) // decontaminate.SPAN
        words = np.arange(1, length + 1, dtype=np.uint64)
        index = decontaminate.SeedIndex([(7, words)])
        for changed in combinations(range(length), most):
            other = words.copy()
            other[list(changed)] += np.uint64(1000)
            found = decontaminate.overlaps(index, np.concatenate([[np.uint64(5000)] * 3, other, [np.uint64(6000)]]).astype(np.uint64))
            assert found == [(0, length - most, 3, 0, length)], (length, changed)


def test_short_items_tolerate_substitutions(spark):
    items = [[f"w{n}_{k}" for k in range(n)] for n in range(6, 13)]
    docs = [" ".join(["before", *("x" if k == p else w for k, w in enumerate(item)), "after"]) for item in items for p in range(len(item))]
    bench = spark.createDataFrame([(len(item), " ".join(item)) for item in items], "item_id long, text string")
    got = Counter(r["item_id"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect())
    assert got == {n: n for n in range(6, 13)}
