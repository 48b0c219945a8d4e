"""Chunks that hold two or three words in all."""

import numpy as np
import pytest

from siftmill.llm import near_dedup
from siftmill.llm.kernels import shingle_sets

from .test_kernels_and_edges import brute_near, frame


@pytest.mark.parametrize("width", [4, 5])
def test_chunks_of_few_words_have_shingles(width):
    for n in range(6):
        words = np.arange(1, n + 1, dtype=np.uint64)
        (one,) = shingle_sets(words, np.array([0, n]), width)
        beside, _ = shingle_sets(np.arange(1, n + 10, dtype=np.uint64), np.array([0, n, n + 9]), width)
        assert len(one) == (0 if not n else max(1, n - width + 1)) and one.tolist() == beside.tolist()


def test_near_duplicates_of_two_and_three_words(spark):
    long = [" ".join(f"{x}{k}" for k in range(60_000)) for x in "ab"]
    for many in (["one two"], ["one two three"], [long[0], "one two", long[1]], [long[0], "one two three", long[1], "one two three"]):
        got = near_dedup.near_duplicates(frame(spark, many).coalesce(1), width=5, percent=80).collect()
        want = brute_near(many, list(range(len(many))), 5, 80)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
