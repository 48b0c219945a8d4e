"""Importance resampling against plain Python: n-grams, hashes, models, weights, noise and the rows taken."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmill.llm import quality

from .test_kernels_and_edges import frame

M = (1 << 64) - 1
SF = "/root/testdata/sf0.001"


def mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & M
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def grams(text):
    """The text's n-grams as buckets, with their numbers."""
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    hashes = []
    for w in re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\x20\x09-\x0d]+", raw):
        value = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & M
        hashes.append(mix(value ^ (len(w) << 52 & M)))
    pairs = [mix((a * 3 + b * 5) & M) for a, b in zip(hashes, hashes[1:])]
    return Counter(h % quality.BUCKETS for h in hashes + pairs)


def brute(rows, labelled, targets, k, seed=7):
    """(doc_id, text) rows -> {doc_id: (weight, key)} of the rows taken; keys are unique here."""
    models = {i: grams(t) for i, t in rows}
    raw, hit = Counter(), Counter()
    for i, g in models.items():
        raw.update(g)
        if i in targets:
            hit.update(g)
    share = sum(hit.values()) / sum(raw.values())
    ratio = {b: math.log((hit[b] + quality.PSEUDO) / (n * share + quality.PSEUDO)) for b, n in raw.items()}
    out = {}
    for i, g in models.items():
        weight = quality.LENGTH * sum(n * ratio[b] for b, n in g.items()) / max(1, sum(g.values()))
        u = (int(hashlib.md5(f"{seed}/{i}".encode()).hexdigest()[:15], 16) + 0.5) / (1 << 60)
        out[i] = weight, weight - math.log(-math.log(u))
    k = -(-len(rows) * len(targets) // labelled) if k is None else k
    return dict(sorted(out.items(), key=lambda x: -x[1][1])[:k]), ratio


def same(got, want):
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        assert abs(r["log_weight"] - want[r["doc_id"]][0]) < 1e-6 and abs(r["gumbel_key"] - want[r["doc_id"]][1]) < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_rows_taken_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    want, ratio = brute(rows, len(marks), {i for i, good in marks.items() if good}, None)
    same(quality.resample(docs, labels, (F.col("quality") == 1) & (F.col("toxic") == 0)).collect(), want)
    assert all(x != 0 for x in ratio.values()) and 0 < len(want) < len(rows)


def test_odd_texts_equal_brute_force(spark):
    texts = ["good words here", "good words again, here!", "bad ### words ###", None, "", " \t\n", "Ünïcode good", "x" * 300_000, "good words " * 40_000, "the the the", "good words here"]
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (6, 1), (6, 1), (None, 1)], "doc_id long, good int")
    for k in (1, 5, 11):
        want, _ = brute(list(enumerate(texts)), 4, {0, 1, 6}, k)
        same(quality.resample(frame(spark, texts), labels, F.col("good") == 1, k=k).collect(), want)


def test_long_texts_have_no_advantage(spark):
    weights = {r["doc_id"]: r["log_weight"] for r in quality.resample(frame(spark, ["a b a b a b a b", "a b " * 5000, "c d " * 50]), spark.createDataFrame([(2, 1)], "doc_id long, good int"), F.col("good") == 1, k=3).collect()}
    assert abs(weights[0] - weights[1]) < 0.2 * abs(weights[0]) and weights[2] > max(weights[0], weights[1])
