"""Cells against the exact search; grouped scoring whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import cells, models, retrieval
from siftmill.sources.index import Index

from .test_index import ROWS, row


def rows_of(n, seed=1, centres=12, dims=8):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(f"c{k:04}", [x + rng.gauss(0, 0.3) for x in middle[k % centres]]) for k in range(n)]


def plain(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([*rows_of(600), ("none", None), ("zero", [0.0] * 8), *[(f"same{k}", [1.0] * 8) for k in range(300)]], "chunk_id string, vector array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(k, v) for k, (_, v) in enumerate(rows_of(30, 1))] + [(99, None)], "query_id long, vector array<float>")


def test_all_cells_are_exact_and_a_few_find_most(spark, vectors, asked, tmp_path):
    held = cells.VectorCells(spark, str(tmp_path / "v")).build(vectors, 12, sample_rows=400)
    exact = retrieval.dense_topk(vectors, asked, 7, digits=6)
    assert plain(held.topk(asked, 7, digits=6)) == plain(exact)
    assert spark.read.parquet(f"{held.path}/rows").count() == 900
    told, found = {}, {}
    for probe in (1, 3):
        found[probe] = cells.recall(held.topk(asked, 7, probe, digits=6, told=told), exact).agg(F.avg("recall")).first()[0]
    assert found[3] >= 0.9 and found[1] <= found[3] and told["cells"] == 12
    probe = held.tune(vectors.where("chunk_id < 'c0300'").select(F.crc32("chunk_id").alias("query_id"), "vector"), 7, 0.9)
    assert 1 <= probe < 12 and cells.recall(held.topk(asked, 7, probe), exact).agg(F.avg("recall")).first()[0] >= 0.85
    one = held.topk(asked.where("query_id = 0"), 7, 1, told=told)
    assert told["read"] == 1 and one.count() == 7
    assert all("cell=" in f for f in one.inputFiles())
    keep = spark.createDataFrame([("c0000",), ("c0012",)], "chunk_id string")
    assert {r["chunk_id"] for r in held.topk(asked, 5, keep=keep).collect()} == {"c0000", "c0012"}


def test_no_vectors_and_fewer_than_cells(spark, asked, tmp_path):
    empty = spark.createDataFrame([("a", None)], "chunk_id string, vector array<float>")
    assert cells.VectorCells(spark, str(tmp_path / "e")).build(empty, 4).topk(asked, 3).count() == 0
    two = spark.createDataFrame(rows_of(2), "chunk_id string, vector array<float>")
    assert cells.VectorCells(spark, str(tmp_path / "t")).build(two, 8).topk(asked.where("query_id = 0"), 3).count() == 2


@pytest.mark.parametrize("where", [None, "f1"])
def test_an_index_that_goes_on_after_its_cells(spark, asked, tmp_path, where):
    index = Index(spark, str(tmp_path / "i"))
    made = lambda rows: spark.createDataFrame([row(c, f"f{int(c[1:]) % 5}", "t", vector=v) for c, v in rows], ROWS)
    index.upsert(made(rows_of(200)))
    held = cells.build_for(index, str(tmp_path / "v"), 6)
    cond = None if where is None else F.col("file_path") == where
    for step in range(4):
        if step == 1:
            index.upsert(made(rows_of(60, seed=9)))
        if step == 2:
            index.delete_files(spark.createDataFrame([("f2",)], "file_path string"))
        if step == 3:
            index.compact()
        if where is None or step == 2:
            assert plain(cells.dense_topk(index, held, asked, 5, where=cond, digits=6)) == plain(retrieval.dense_topk(index.read(), asked, 5, cond, digits=6))


def test_passages_of_a_query_come_together(spark):
    rng = random.Random(2)
    rows = [(q, f"q{q}" if q else None, r, "x" * rng.randrange(1, 9) if r % 4 else None, 7.0) for q in range(6) for r in range(1, 12)]
    hits = spark.createDataFrame(rows, "query_id long, query string, rank int, text string, score double").repartition(3)

    class Once:
        def score(self, query, passages):
            assert len(passages) == 11
            return models.RelativeReranker().score(query, passages)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r["query_id"], r["rank"]): r["score"] for r in models.rerank_groups(hits, Once()).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total = {q: sum(len(t or "") for p, _, _, t, _ in rows if p == q) for q in range(6)}
    assert got == {(q, r): len(t or "") / total[q] for q, _, r, t, _ in rows}

    class Short:
        def score(self, query, passages):
            return [1.0]

    with pytest.raises(Exception, match="gave 1 scores"):
        models.rerank_groups(hits, Short()).collect()


def test_own_chunker_and_relevance(spark, tmp_path):
    from siftmill.functions import text as tx
    from siftmill.plans.ingest import ingest
    from siftmill.plans.service import SearchService
    from siftmill.sources import config

    class Lines:
        def chunks(self, docs):
            cut = docs.select("file_path", "source_sha", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
            return cut.withColumns({"header": F.lit(""), "line_start": F.lit(1), "window_text": F.lit("")}).withColumn("chunk_id", tx.chunk_id(F.col("file_path"), F.col("line_start"), F.col("chunk_index")))

    class Long:
        def column(self, query, text):
            return (F.length(text) > 9).cast("double")

    index = Index(spark, str(tmp_path / "i"))
    files = spark.createDataFrame([("a.md", "1", "ripe apple\napple\nred apple pie")], "path string, sha string, content string")
    assert ingest(files, index, models.HashEmbedder(8), chunker=Lines())["processed"] == 1
    run = SearchService.over(index, models.HashEmbedder(8), settings=config.Retrieval(chunk_filter=True), relevance=Long())
    queries = spark.createDataFrame([(0, "apple")], "query_id long, query string")
    assert sorted(r["text"] for r in run.keyword(queries, 3).collect()) == ["red apple pie", "ripe apple"]
