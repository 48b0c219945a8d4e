"""The service with a judge, answers and a cache."""

from pyspark.sql import functions as F

from siftmill.operators import models, postprocess
from siftmill.plans import service
from siftmill.sources import config
from siftmill.sources.index import Index

CHUNKS = "chunk_id string, file_path string, header string, line_start int, chunk_index int, text string, window_text string, source_sha string, vector array<float>"
TEXTS = ["ripe apple", "plain fruit bowl", "red plum", "apple window"]


class Judge:
    """Rates passages with a plum; answers questions about windows with nonsense and fails on those about seats."""

    def generate(self, prompts):
        if any("Query: seat" in p for p in prompts):
            raise models.ModelError("no")
        return ["nonsense" if "Query: window" in p else "[" + ", ".join("1" if "plum" in x else "0" for x in p.split("Passages:\n")[1].split("\n\n")[:-1]) + "]" for p in prompts]




def corpus(spark):
    vectors = models.HashEmbedder(16).embed(TEXTS)
    return spark.createDataFrame([(f"c{k}", f"f{k}.md", "", 1, 0, t, f"wide {t}", "", v) for k, (t, v) in enumerate(zip(TEXTS, vectors, strict=True))], CHUNKS)


def test_judge_sees_shown_texts_and_its_failures_keep_hits(spark):
    run = service.SearchService(corpus(spark), models.HashEmbedder(16), config.Retrieval(chunk_filter=True), judge=Judge())
    queries = spark.createDataFrame([(1, "red plum"), (2, "window"), (3, "seat"), (4, "ripe apple")], "query_id long, query string")
    rows = run.search(queries, 3).collect()
    kept = {q: [r["text"] for r in rows if r["query_id"] == q] for q in (1, 2, 3, 4)}
    assert kept[1] == ["wide red plum"]
    plain = service.SearchService(corpus(spark), models.HashEmbedder(16)).search(queries, 3).collect()
    for q in (2, 3):
        assert sorted(kept[q]) == sorted(r["text"] for r in plain if r["query_id"] == q)


def test_filter_prompt_numbers_passages_by_rank(spark):
    hits = spark.createDataFrame([(1, "q", 7, "b"), (1, "q", 2, "a"), (2, None, 1, None)], "query_id long, query string, rank int, text string")
    got = {r["query_id"]: r["prompt"] for r in postprocess.filter_prompts(hits).collect()}
    assert got[1].endswith("Passages:\n[1] a\n\n[2] b\n\n") and "Query: q\n" in got[1] and got[2].endswith("[1] \n\n")
    assert postprocess.filter_prompts(hits.limit(0)).count() == 0


def test_answers(spark):
    run = service.SearchService(corpus(spark), models.HashEmbedder(16), generator=models.EchoGenerator())
    queries = spark.createDataFrame([(1, "red plum"), (2, "apple?")], "query_id long, query string")
    assert {r["query_id"]: r["answer"] for r in run.answer(queries, 2).collect()} == {1: "red plum", 2: "apple?"}
    nothing = service.SearchService(corpus(spark).limit(0), models.HashEmbedder(16), generator=models.EchoGenerator())
    assert nothing.answer(queries, 2).count() == 0


def test_cache_is_written_and_read(spark, tmp_path):
    cache = Index(spark, str(tmp_path / "cache"), postprocess.RESULT_CACHE, by="id", key="id", optional="")
    settings = config.Cache(threshold=0.99, ttl_seconds=3600)
    at = lambda hour: F.to_timestamp(F.lit(f"2024-01-01 0{hour}:00:00"))
    queries = spark.createDataFrame([(1, "red plum"), (2, "ripe apple"), (3, "ripe apple")], "query_id long, query string")
    full = service.SearchService(corpus(spark), models.HashEmbedder(16))
    first = sorted(map(str, full.cached_search(queries, cache, settings, 2, now=at(1)).collect()))
    assert first == sorted(map(str, full.search(queries, 2).select("query_id", *postprocess.RESULT_FIELDS).collect()))
    assert cache.read().count() == 2
    # What the cache holds is not searched again, as an empty index shows, and is cut to the rows asked for.
    empty = service.SearchService(corpus(spark).limit(0), models.HashEmbedder(16))
    assert sorted(map(str, empty.cached_search(queries, cache, settings, 2, now=at(2)).collect())) == first
    assert {r["rank"] for r in empty.cached_search(queries, cache, settings, 1, now=at(2)).collect()} == {1}
    # Expired entries are searched, and a query without results leaves the cache as it was.
    assert empty.cached_search(queries, cache, settings, 2, now=at(3)).count() == 0 and cache.read().count() == 2
    assert sorted(map(str, full.cached_search(queries, cache, settings, 2, now=at(4)).collect())) == first
    assert {str(r["cached_at"]) for r in cache.read().collect()} == {"2024-01-01 04:00:00"}


