"""The tree of LM scoring is whole: no cap, and it grows with the input."""

import random
import zlib

import numpy as np

from siftmill.llm import lm

from .test_kernels_and_edges import brute_tree, common_column, frame, texts, tree_rows  # noqa: F401


def test_lm_tree_has_every_context_that_diverges(spark, texts):  # noqa: F811
    many = texts * 12
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(frame(spark, many), block_bytes=5000, bucket_bytes=20000).collect()}
    data, offsets = common_column(many)
    text, begin = lm.symbols(data, offsets - offsets[0])
    train = np.repeat([zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(many))], np.diff(begin))
    keys, n = np.unique(lm.grams(text, begin, lm.DEPTH)[train], return_counts=True)
    table = {}
    for d, c, s, m in tree_rows(keys, n, lm.DEPTH, lm.DIVERGENCE):
        table.setdefault((d, c), {})[s] = m
    assert max(d for d, _ in table) == lm.DEPTH > 5
    want = [brute_tree(table, bytes(text[begin[k] : begin[k + 1]]), lm.DEPTH) for k in range(len(many))]
    assert np.allclose([got[k] for k in range(len(many))], want, rtol=1e-5)


def test_lm_tree_grows_with_the_input():
    rng = random.Random(8)
    spelled = lambda n: np.array([(rng.randrange(1 << 24) << 8) | rng.randrange(97, 100) for _ in range(n)], np.uint64)
    sizes = []
    for n in (60_000, 240_000):
        # Every context has 40 positions and one symbol of its own: evidence for each, whatever their number.
        contexts = spelled(n // 40)
        keys, counts = np.unique(np.repeat(contexts, 40), return_counts=True)
        sizes.append(sum(int(x.kept.sum()) for x in lm.levels(keys, counts, range(4))[1:]))
    assert sizes[1] > 3 * sizes[0]


def test_null_and_repeated_keys_are_spread_over_blocks(spark):
    many = [f"word{k} of text {k % 7}" for k in range(60)]
    ids = [None] * 30 + [5] * 30
    got = lm.score_documents(frame(spark, many, ids=ids), block_bytes=100, bucket_bytes=400).collect()
    whole = lm.score_documents(frame(spark, many, ids=ids)).collect()
    close = lambda rows: sorted((r["doc_id"] is None, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in rows)
    assert close(got) == close(whole) and len(got) == 60
