"""What single failures and large numbers may not disturb: files, hypothetical documents, fragments, roots, slices."""

from pyspark.sql import functions as F

from siftmill.operators import models, retrieval
from siftmill.plans import service
from siftmill.plans.ingest import ingest
from siftmill.sources import config
from siftmill.sources.files import fetch_files
from siftmill.sources.index import Index

CHUNKS = "chunk_id string, file_path string, header string, line_start int, chunk_index int, text string, window_text string, source_sha string, vector array<float>"


class Picky(models.HashEmbedder):
    def embed(self, texts):
        if any("broken" in t for t in texts):
            raise models.ModelError("no")
        return super().embed(texts)


class Silent(models.EchoGenerator):
    """Answers nothing to questions about fruit."""

    def generate(self, prompts):
        return ["" if "fruit" in p else "ripe apple" for p in prompts]


def test_a_failing_file_is_counted_and_the_others_go_on(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    files = lambda *rows: spark.createDataFrame(rows, "path string, sha string, content string")
    assert ingest(files(("a.md", "1", "# A\n\none"), ("b.md", "1", "# B\n\nfine"), ("c.md", "1", "# C\n\nbroken")), index, Picky(4)) == {"processed": 2, "skipped": 0, "failed": 1}
    assert {r["file_path"] for r in index.read().collect()} == {"a.md", "b.md"}
    for mode in ("upsert", "replace"):
        again = files(("a.md", "1", "# A\n\none"), ("b.md", mode, "# B\n\nfine\n\n# D\n\nbroken"), ("c.md", "1", "# C\n\nbroken"))
        assert ingest(again, index, Picky(4), mode=mode) == {"processed": 0, "skipped": 1, "failed": 2}
        assert sorted(r["text"] for r in index.read().collect()) == ["fine", "one"]


def test_more_than_a_thousand_fragments(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"f{k}.md", "", 1, 0, f"word{k} text", "", "", [1.0, float(k)]) for k in (0, 999, 1000, 1001)], CHUNKS)
    asked = spark.createDataFrame([(4, "; ".join(f"word{k}" for k in range(1002))), (5, "word0")], "query_id long, query string")
    got = retrieval.multi_fragment_search(chunks, asked, 10, lambda t: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"), prefetch=1).collect()
    assert {r["chunk_id"] for r in got if r["query_id"] == 4} == {"c0", "c999", "c1000", "c1001"} and {r["query_id"] for r in got} == {4, 5}


def test_queries_without_hypothetical_documents_are_searched_by_fragments(spark):
    embedder = models.HashEmbedder(8)
    texts = ["ripe apple", "plain fruit bowl", "red plum", "window seat"]
    chunks = spark.createDataFrame([(f"c{k}", f"f{k}.md", "", 1, 0, t, f"wide {t}", "", v) for k, (t, v) in enumerate(zip(texts, embedder.embed(texts), strict=True))], CHUNKS)
    queries = spark.createDataFrame([(1, "which fruit; red plum"), (2, "something else")], "query_id long, query string")
    run = service.SearchService(chunks, embedder, config.Retrieval(hyde=True), None, Silent())
    rows = run.search(queries, 2).collect()
    assert {r["file_path"] for r in rows if r["query_id"] == 1} >= {"f2.md"} and [r["file_path"] for r in rows if r["query_id"] == 2 and r["rank"] == 1] == ["f0.md"]
    plain = service.SearchService(chunks, embedder, config.Retrieval()).search(queries.where("query_id = 1"), 2).collect()
    assert sorted(map(str, plain)) == sorted(str(r) for r in rows if r["query_id"] == 1)


def test_reranker_and_filter_see_the_shown_text(spark):
    class Wide:
        def score(self, query, passages):
            assert all(p.startswith("wide ") for p in passages)
            return [float(len(p)) for p in passages]

    chunks = spark.createDataFrame([("c1", "a.md", "", 1, 0, "apple", "wide apple pie", "", [1.0, 0.0]), ("c2", "b.md", "", 1, 0, "apple", "wide apple", "", [1.0, 0.0])], CHUNKS)
    run = service.SearchService(chunks, models.HashEmbedder(2), config.Retrieval(chunk_filter=True), Wide())
    assert [r["text"] for r in run.keyword(spark.createDataFrame([(1, "apple")], "query_id long, query string"), 2).orderBy("rank").collect()] == ["wide apple pie", "wide apple"]


def test_equal_paths_under_two_roots(spark):
    files = spark.createDataFrame([("a.md", "x", "1"), ("a.md", "y", "2")], "path string, root string, content string")
    assert sorted(r["content"] for r in fetch_files(files, files.select("path", "root")).collect()) == ["1", "2"]


def test_slices_of_a_batch_change_nothing(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{k:03}", [float(k % 7), 1.0, float(k % 3)]) for k in range(200)] + [("z", None), ("o", [0.0, 0.0, 0.0])], "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(q, [1.0, float(q), 2.0]) for q in range(5)], "query_id long, vector array<float>")
    whole = sorted(map(str, retrieval.dense_topk(chunks, queries, 6, digits=6).collect()))
    monkeypatch.setattr(retrieval, "SLICE_NUMBERS", 40)
    assert sorted(map(str, retrieval.dense_topk(chunks, queries, 6, digits=6).collect())) == whole and len(whole) == 30
