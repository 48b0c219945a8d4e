"""Steps of the queries over all documents that move no texts."""

import re
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from siftmill.operators import models, retrieval
from siftmill.plans import catalogue, ingest
from siftmill.sources.index import Index


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_vectors_are_counted_in_each_row(spark):
    texts = ["", None, " ,; ", "a", "b a b", "The THE the of", "x " * 5000 + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    made = catalogue.with_sparse(rows, "text")
    assert not re.search("Exchange|Aggregate|Join", physical(made))
    for r in made.collect():
        counts = Counter(int(md5(t.encode()).hexdigest()[:7], 16) for t in re.findall(r"\w+", (r["text"] or "").lower()))
        assert list(zip(r["sparse_indices"], r["sparse_values"], strict=True)) == sorted(counts.items())


def test_plans_without_vectors_do_not_join_them(spark):
    chunks = catalogue.corpus(spark, "/root/testdata/sf0.001")
    assert not re.search("Exchange|Join", physical(chunks.select("chunk_id", "text").where(F.length("text") > 0)))
    assert chunks.count() == chunks.where("vector is null").count() + chunks.where("vector is not null").count()


def test_hits_go_to_the_texts(spark):
    chunks = catalogue.corpus(spark, "/root/testdata/sf0.001")
    hits = chunks.select("chunk_id").limit(3).select(F.lit(0).alias("query_id"), "chunk_id", F.lit(1).alias("rank"), F.lit(0.5).alias("score"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (retrieval.results(hits, chunks), retrieval.collapse(hits, chunks, "rank")):
            assert "BroadcastHashJoin" in physical(made) and "SortMergeJoin" not in physical(made)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_queries_go_to_the_vectors(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = catalogue.queries_table(spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" in physical(made) and "Exchange hashpartitioning" not in physical(made)
        assert [(r["query_id"], r["query"], len(r["vector"])) for r in made.orderBy("query_id").collect()] == [(k, t, 64) for k, t in enumerate(catalogue.TEXTS)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_an_ingest_run_moves_no_texts(spark, tmp_path, monkeypatch):
    seen, change = [], Index.change
    monkeypatch.setattr(Index, "change", lambda self, new, gone, **more: (seen.append(physical(new)), change(self, new, gone, **more))[1])
    chunked = ingest.prepare_chunks
    monkeypatch.setattr(ingest, "prepare_chunks", lambda files, *more: (made := chunked(files, *more), seen.append(physical(made)))[0])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = Index(spark, str(tmp_path / "i"))
        files = lambda *rows: spark.createDataFrame(rows, "path string, root string, sha string, content string")
        for sha in ("1", "2"):
            assert ingest.ingest(files(("a.md", "r", sha, f"a {sha}"), ("fr/b.md", "r", sha, "b"), ("c.md", "r", "1", "c")), index, models.LengthEmbedder("fr/"), mode="replace")["failed"] == 1
        assert len(seen) == 4 and not any(re.search("Exchange hashpartitioning|SortMergeJoin", plan) for plan in seen)
        # Of one path under two roots the last root's text is chosen.
        ingest.ingest(files(("a.md", "r", "3", "first"), ("a.md", "s", "4", "second")), index, models.LengthEmbedder(), mode="replace")
        assert {r["file_path"]: r["text"] for r in index.read().collect()} == {"a.md": "second", "c.md": "c"}
        assert {r["file_path"]: r["source_sha"] for r in index.file_shas().collect()} == {"a.md": "4", "c.md": "1"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
