"""The pipeline against plain Python versions of its stages, on the smallest tables."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

from siftmill.llm import decontaminate, queries

from .test_kernels_and_edges import brute_near, brute_targets, words
from .test_quality_brute_force import brute as brute_taken

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def brute_hits(docs, items):
    out = set()
    for i, t in docs.items():
        w = words(t)
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        for k, item in items.items():
            for shift in {p - q for q, x in enumerate(item) for p in at[x]}:
                lo, hi = max(0, -shift), min(len(item), len(w) - shift)
                same = [item[q] == w[q + shift] for q in range(lo, hi)]
                width = min(decontaminate.SPAN, len(item))
                if any(sum(same[a : a + width]) * decontaminate.SPAN >= decontaminate.MIN_MATCH * width for a in range(len(same) - width + 1)):
                    out.add((i, k))
    return out


def brute_mix(docs, sources):
    size = {i: len(words(t)) for i, t in docs.items()}
    per = Counter()
    for i in docs:
        per[sources[i]] += size[i]
    goal = brute_targets(per, queries.MIX_WEIGHTS, 1.5 * sum(per.values()), queries.MIX_MOST)
    copies = {}
    for s in per:
        whole = int(goal[s] // per[s]) if per[s] else 0
        rest, total = goal[s] - whole * per[s], 0
        for i in sorted((i for i in docs if sources[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15]):
            total += size[i]
            copies[i] = whole + (rest > 0 and total <= rest)
    return copies


def test_pipeline_equals_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        made[name] = out.collect()
        if name != "sharding":
            assert out.columns == columns
            docs = spark.createDataFrame(made[name], out.schema)
    text = lambda name: {r["doc_id"]: r["text"] for r in made[name]}
    kept = text("quality")
    near = brute_near(list(kept.values()), list(kept), 5, 80)
    assert set(text("near_dedup")) == {i for i, (_, _, k) in near.items() if k} and len(kept) < 200
    before = text("near_dedup")
    assert set(before) - set(text("decontaminate")) == {i for i, _ in brute_hits(before, items)}
    clean = text("decontaminate")
    copies = brute_mix(clean, {r["doc_id"]: r["source"] for r in made["decontaminate"]})
    assert Counter(r["doc_id"] for r in made["mixing"]) == {i: n for i, n in copies.items() if n}
    assert Counter(r["doc_id"] for r in made["sharding"]) == Counter(r["doc_id"] for r in made["mixing"])
    slots = defaultdict(list)
    for r in made["sharding"]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, whole)) == sorted(map(str, made["sharding"]))


def test_quality_stage_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    want, _ = brute_taken(rows, len(marks), {i for i, good in marks.items() if good}, None)
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()} == set(want)


def test_stages_keep_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies long, _copy string, row string, col int, _i int, shard string, slot string, _hit int"
    rows = [(k, f"some words {k} of text {k * 7}", "en", f"s{k % 3}", 20, 5, "c", "r", 1, 2, "x", "y", 3) for k in range(30)]
    rows += [(None, None, None, None, None, 1, None, None, None, None, None, None, None)] * 2
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, schema), SF)
        got = out.collect()
        if name != "sharding":
            assert out.columns == [x.split()[0] for x in schema.split(", ")]
        if name in ("near_dedup", "decontaminate"):
            assert len(got) == 32
        if name == "mixing":
            assert all(r["copies"] in (5, 1) and r["_copy"] in ("c", None) for r in got) and 30 <= len(got) <= 64


def test_decontamination_takes_null_keys_and_whole_long_texts(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "filler words " * 100_000
    rows = [(None, item, "en", "s", 1), (None, "clean", "en", "s", 1), (1, long + item, "en", "s", 1), (2, long, "en", "s", 1), (3, item, "en", "s", 1), (3, "clean", "en", "s", 1)]
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, schema), SF).collect()] == [2]


def test_stages_without_labels_and_benchmark(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_survive_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x y z " * 50, "en", None, 300)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            got = out.collect()
            if name != "sharding":
                assert out.columns == schema.replace(" long", "").replace(" string", "").split(", ") and len(got) <= 2 * table.count()
