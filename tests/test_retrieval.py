"""Fusion, filters, cache, prompt, models, files, index, ingest and streaming."""

import pytest
from pyspark.sql import functions as F

from siftmill.operators import models, postprocess, retrieval
from siftmill.plans import service
from siftmill.plans.ingest import counters, file_status, ingest
from siftmill.sources import config
from siftmill.sources.files import convert_pdfs, fetch_files, list_markdown
from siftmill.sources.index import Index, changed_files, upsert
from siftmill.streaming.file_ingest import stream_files

CHUNK = "chunk_id string, file_path string, header string, line_start int, chunk_index int, text string, window_text string, source_sha string, vector array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("c1", "a.md", "H", 1, 0, "red apple pie", "", "s", [1.0, 0.0]),
        ("c2", "a.md", "H", 1, 1, "green apple", "wide text", "s", [0.9, 0.1]),
        ("c3", "b.md", "", 5, 0, "blue plum", "", "s", [0.5, 0.5]),
        ("c4", "c.md", "", 9, 0, "Apple apple APPLE", "", "t", [0.0, 1.0]),
        ("c5", "d.md", "", 9, 0, "zero", "", "t", [0.0, 0.0]),
        ("c6", "e.md", "", 9, 0, "none", "", "t", None),
    ]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, "apple", [1.0, 0.0]), (1, "plum zebra", [0.0, 1.0]), (2, "?!", None)], "query_id long, query string, vector array<float>")


def hits(df):
    return [(r["query_id"], r["rank"], r["chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_legs(chunks, queries):
    assert hits(retrieval.dense_topk(chunks, queries, 2)) == [(0, 1, "c1"), (0, 2, "c2"), (1, 1, "c4"), (1, 2, "c3")]
    assert hits(retrieval.dense_topk(chunks, queries, 1, F.col("file_path") != "a.md")) == [(0, 1, "c3"), (1, 1, "c4")]
    assert hits(retrieval.keyword_search(chunks, queries, 2)) == [(0, 1, "c1"), (0, 2, "c2")]
    assert hits(retrieval.lexical_leg(chunks, queries, 3)) == [(0, 1, "c4"), (0, 2, "c1"), (0, 3, "c2")]
    assert hits(retrieval.lexical_leg(chunks, queries, 1, candidates="best")) == [(0, 1, "c4")]
    assert hits(retrieval.dense_topk(chunks.limit(0), queries, 2)) == [] and hits(retrieval.dense_topk(chunks, queries.limit(0), 2)) == []


def test_fusion_takes_the_worst_rank_of_a_section(spark):
    dense = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "x", 3), (0, "c", 4)], "query_id long, chunk_id string, rank int")
    lexical = spark.createDataFrame([(0, "a", 2), (0, "b", 1)], "query_id long, chunk_id string, rank int")
    where = spark.createDataFrame([("a", "f", 1), ("c", "f", 1), ("b", "g", 1), ("x", "h", 1)], "chunk_id string, file_path string, line_start int")
    worst = retrieval.fuse(retrieval.collapse(dense, where, "rank"), retrieval.collapse(lexical, where, "rank"), 5)
    got = {r["chunk_id"]: r["score"] for r in worst.collect()}
    assert got["a"] == round(1 / 64 + 1 / 62, 9) and got["b"] == round(1 / 62 + 1 / 61, 9) and got["x"] == round(1 / 63, 9)
    best = retrieval.fuse(retrieval.collapse(dense, where, "rank", "best"), retrieval.collapse(lexical, where, "rank"), 1)
    assert hits(best) == [(0, 1, "a")]


def test_search_and_results(chunks, queries):
    found = retrieval.search(chunks, queries, 2)
    rows = retrieval.results(found, chunks).orderBy("query_id", "rank").collect()
    assert [r["file_path"] for r in rows if r["query_id"] == 0] == ["c.md", "a.md"] and {r["query_id"] for r in rows} == {0, 1}
    only = retrieval.search(chunks, queries, 3, retrieval.payload_filter(file_path="c.md"))
    assert {h[2] for h in hits(only)} == {"c4"}
    assert retrieval.payload_filter() is not None
    assert [r["text"] for r in retrieval.results(found, chunks).where("line_start = 1").collect()]


def test_multi_fragment_merges_by_section(chunks, spark):
    asked = spark.createDataFrame([(4, "apple? plum")], "query_id long, query string")
    got = hits(retrieval.multi_fragment_search(chunks, asked, 5, lambda t: F.array(F.length(t) / 5, F.lit(0.2)).cast("array<float>")))
    assert {g[0] for g in got} == {4} and len({g[2] for g in got}) == len(got) and [g[1] for g in got] == list(range(1, len(got) + 1))


def test_sparse_scores(spark):
    docs = spark.createDataFrame([("a", [1, 2, 2], [1.0, 5.0, 7.0]), ("b", [3], [2.0])], "chunk_id string, sparse_indices array<long>, sparse_values array<float>")
    asked = spark.createDataFrame([(0, [2, 3], [1.0, 4.0])], "query_id long, sparse_indices array<long>, sparse_values array<float>")
    assert {r["chunk_id"]: r["score"] for r in retrieval.sparse_scores(docs, asked).collect()} == {"a": 7.0, "b": 8.0}


def test_relevance_filter(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0.9), (0, "b", 2, 0.1), (1, "c", 1, 0.1), (2, "d", 1, None), (2, "e", 2, 0.9), (3, "f", 1, 0.5)], "query_id long, chunk_id string, rank int, rel double")
    assert {r["chunk_id"] for r in postprocess.relevance_filter(rows, F.col("rel")).collect()} == {"a", "c", "d", "e", "f"}
    replies = spark.createDataFrame([(0, "```json\n[0.9, 0.2]\n```"), (1, "[0.1]"), (2, "[1]")], "query_id long, reply string")
    got = {r["chunk_id"] for r in postprocess.filter_by_replies(rows.drop("rel"), replies).collect()}
    assert got == {"a", "c", "d", "e", "f"}


def test_rag_context_budget(spark):
    rows = spark.createDataFrame([(0, k, "f.md", "x" * 100) for k in range(1, 6)], "query_id long, rank int, file_path string, text string")
    entry = len("[1] (source: f.md)\n") + 102
    for tokens, want in ((entry // 4 + 1, 1), (10, 0), (20, 1), (1000, 5)):
        got = postprocess.rag_entries(rows, 4 * tokens).orderBy("place").collect()
        assert len(got) == want and sum(len(r["entry"]) for r in got) <= 4 * tokens
    assert postprocess.rag_entries(rows, 80).first()["entry"].endswith("...")
    text = postprocess.rag_prompt(postprocess.rag_context(rows), spark.createDataFrame([(0, "why"), (1, "how")], "query_id long, query string")).orderBy("query_id").collect()
    assert "[5] (source: f.md)" in text[0]["prompt"] and "Question: why\n\nAnswer:" in text[0]["prompt"] and "Context:\n\n\nQuestion: how" in text[1]["prompt"]


def test_cache(spark):
    cache = spark.createDataFrame([("i", [1.0, 0.0], ["r1", "r2", "r3"], "2024-01-01 00:00:00"), ("j", [0.0, 1.0], ["r4"], None)], "id string, vector array<float>, results array<string>, cached_at string").withColumn("cached_at", F.to_timestamp("cached_at"))
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.8, 0.6])], "query_id long, vector array<float>")
    at = lambda s: F.to_timestamp(F.lit(s))
    ids = lambda *a: sorted(r["query_id"] for r in postprocess.cache_lookup(cache, asked, *a).collect())
    assert ids(at("2024-01-01 01:00:00"), 0.8, 3600) == [0, 1, 2]
    assert ids(at("2024-01-01 01:00:01"), 0.8, 3600) == [1] and ids(at("2030-01-01 00:00:00"), 0.81, 0) == [0, 1]
    found = postprocess.cache_or_search(cache, asked, 2, lambda q: q.select("query_id", F.lit(1).alias("rank"), F.lit("new").alias("chunk_id")), at("2024-01-01 00:00:05"), 0.9, 60)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["from_cache"]) for r in found.collect()) == [(0, 1, "r1", True), (0, 2, "r2", True), (1, 1, "r4", True), (2, 1, "new", False)]
    made = postprocess.cache_entries(asked.withColumn("query", F.lit("q")), found.where("query_id = 0"), at("2024-01-01 00:00:05")).first()
    assert made["results"] == ["r1", "r2"]


def test_hyde(chunks, queries, spark):
    class Half:
        def generate(self, prompts):
            return ["" if "plum" in p else "answer" for p in prompts]

    class Broken:
        def generate(self, prompts):
            raise RuntimeError

    embedder = models.HashEmbedder(2)
    got = {r["query_id"]: r["vector"] for r in postprocess.hyde_vectors(queries, 5, Half(), embedder, several=True).collect()}
    assert got[0] is not None and got[1] is None
    assert {r["vector"] for r in postprocess.hyde_vectors(queries, 2, Broken(), embedder).select(F.col("vector").cast("string")).collect()} == {None}
    prompts = models.hyde_prompts(queries.where("query_id = 0"), 10, several=True).orderBy("doc_no").collect()
    assert len({r["prompt"] for r in prompts[:5]}) == 5 and prompts[5]["prompt"] == prompts[0]["prompt"]
    hyde = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vector array<float>")
    plain = hits(retrieval.search(chunks, queries, 1))
    assert hits(postprocess.adaptive_hyde_search(chunks, queries, 1, hyde, threshold=0.0)) == plain
    moved = hits(postprocess.adaptive_hyde_search(chunks, queries, 1, hyde, threshold=0.5))
    assert moved[0] == (0, 1, "c4") and moved[1:] == plain[1:]


def test_models():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError
        return x

    waits = []
    assert models.with_retries(flaky, 3, 1.0, 2.0, waits.append)(5) == 5 and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        models.with_retries(lambda: 1 / 0, 1, 0, 1, lambda s: None)()
    assert models.EchoGenerator().generate(["x Question: why\n\nPassage:"]) == ["why"]


def test_service(chunks, queries, spark):
    class Longest:
        def score(self, query, passages):
            return [float(len(p)) for p in passages]

    run = service.SearchService(chunks, models.HashEmbedder(2), config.Retrieval(chunk_filter=True), Longest(), models.EchoGenerator())
    rows = run.search(queries.select("query_id", "query"), 2).collect()
    assert rows and max(r["rank"] for r in rows) <= 2
    assert run.keyword(queries.select("query_id", "query"), 1).first()["text"] == "Apple apple APPLE"
    assert service.to_json(run.keyword(queries.select("query_id", "query"), 1)).first()["json"].startswith('[{"file_path"')
    asked = spark.createDataFrame([("a", None, 0), ("", "k", 3)], "query string, keyword string, top_k int")
    assert [r["top_k"] for r in service.valid_requests(asked).collect()] == [5, 3]
    bad = spark.createDataFrame([("", None, 0), (None, "k", 2)], "query string, keyword string, top_k int")
    assert [r["keyword"] for r in service.valid_requests(bad).collect()] == ["k"]
    assert [r["error"] is None for r in service.checked_requests(bad).orderBy("top_k").collect()] == [True, False]
    hyde = service.SearchService(chunks, models.HashEmbedder(2), config.Retrieval(hyde=True), None, models.EchoGenerator())
    assert hyde.search(queries, 1, adaptive=True).count() >= 1


def write(folder, **content):
    for name, text in content.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_files_index_and_ingest(spark, tmp_path):
    root = tmp_path / "docs"
    write(root, **{"README.md": "# R\n\none", "docs__intro.MD": "two", "node_modules__x.md": "no", "CLAUDE.md": "no", "a.txt": "no", "empty.md": " \n", "void.md": ""})
    listed = list_markdown(spark, [str(root), ""], ["node_modules/**", "CLAUDE.md"])
    assert {r["path"] for r in listed.collect()} == {"README.md", "docs/intro.MD", "empty.md", "void.md"}
    assert fetch_files(listed, listed.select("path").where("path = 'README.md'")).first()["content"].startswith("# R")
    index = Index(spark, str(tmp_path / "index"))
    assert index.read().count() == 0
    embedder = models.HashEmbedder(4)
    assert ingest(listed, index, embedder) == {"processed": 4, "skipped": 0, "failed": 0}
    assert ingest(listed, index, embedder) == {"processed": 2, "skipped": 2, "failed": 0}
    write(root, **{"README.md": "# R\n\nnew"})
    again = list_markdown(spark, [str(root)], ["node_modules/**", "CLAUDE.md"])
    assert ingest(again, index, embedder, mode="replace")["processed"] == 3
    assert sorted(r["text"] for r in index.read().collect()) == ["new", "two"]
    index.delete_files(spark.createDataFrame([("README.md",)], "file_path string"))
    assert index.read().count() == 1


def test_changed_files_and_counters(spark):
    files = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3"), ("d", "4")], "path string, sha string")
    stored = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "old")], "file_path string, source_sha string")
    assert {r["path"] for r in changed_files(files, stored).collect()} == {"b", "c", "d"}
    assert counters(file_status(files, stored, spark.createDataFrame([("d",)], "path string"))).first().asDict() == {"processed": 2, "skipped": 1, "failed": 1}
    old = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("y", 3), ("z", 4), ("z", 4)], "chunk_id string, v int")
    assert sorted((r["chunk_id"], r["v"]) for r in upsert(old, new).collect()) == [("x", 1), ("y", 3), ("z", 4)]


def test_pdfs(spark, tmp_path):
    write(tmp_path, **{"b.pdf": "B", "a.pdf": "A", "bad.pdf": "x", "n.txt": "n"})

    def convert(data):
        return {b"A": "# A", b"B": "# B"}[data]

    none = spark.createDataFrame([], "stem string, modified timestamp")
    first = convert_pdfs(spark, str(tmp_path), none, convert)
    assert [(r["stem"], r["markdown"]) for r in first.collect()] == [("a", "# A"), ("b", "# B"), ("bad", None)]
    assert convert_pdfs(spark, str(tmp_path), first.select("stem", "modified"), convert).count() == 0


def test_stream_and_listing_name_files_alike(spark, tmp_path):
    folder = tmp_path / "c++ docs (1)" / "in"
    write(folder, **{"a.md": "first", "in__in.md": "nested", "in__x__in__b [1].md": "odd"})
    index = Index(spark, str(tmp_path / "idx"))
    go = lambda: stream_files(spark, str(folder) + "/", index, models.HashEmbedder(4), str(tmp_path / "cp")).awaitTermination(120)
    go()
    write(folder, **{"sub__c.md": "second"})
    go()
    paths = ["a.md", "in/in.md", "in/x/in/b [1].md", "sub/c.md"]
    assert sorted((r["file_path"], r["text"]) for r in index.read().collect()) == list(zip(paths, ["first", "nested", "odd", "second"], strict=True))
    listed = list_markdown(spark, [str(folder)])
    assert sorted(r["path"] for r in listed.collect()) == paths
    assert ingest(listed, index, models.HashEmbedder(4)) == {"processed": 0, "skipped": 4, "failed": 0}


@pytest.mark.parametrize("folders", [1, 3, 64])
def test_listing_of_a_tree(spark, tmp_path, folders):
    root = tmp_path / "r"
    write(root, **{"README.md": "x", ".hidden__h.md": "x", "_u.md": "", "docs__intro.Md": "x", "docs__deep__a__b.md": "x", "docs__deep__skip.txt": "x", "out__never.md": "x", "x__part3.md": "x", "x__part9.md": "x", ".md": "x"})
    (root / "docs" / "out").symlink_to(root / "out")
    (root / "out" / "never.md").chmod(0)
    got = {r["path"]: r for r in list_markdown(spark, [str(root), str(root), ""], ["out/**", "*/part[0-4].md"], folders).collect()}
    assert got.keys() == {"README.md", ".hidden/h.md", "_u.md", "docs/intro.Md", "docs/deep/a/b.md", "x/part9.md", ".md"}
    assert got["_u.md"]["content"] == "" and got["docs/intro.Md"]["absolute"] == f"{root}/docs/intro.Md" and got["README.md"]["root"] == str(root)
    assert list_markdown(spark, [str(root)], ["?/"], folders).count() == 0  # the root itself
    by_uri = list_markdown(spark, [root.as_uri()], ["out/**", "*/part[0-4].md"], folders)
    assert {r["path"] for r in by_uri.collect()} == got.keys()
    wanted = spark.createDataFrame([(f"{root}/README.md", "elsewhere"), ("_u.md", str(root)), ("_u.md", "elsewhere")], "path string, root string")
    assert sorted(str(r["content"]) for r in fetch_files(list_markdown(spark, [str(root)], ["out/**"]), wanted).collect()) == ["", "None", "x"]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("paths: [a, b]\nretrieval: {top_k: 7}\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        pytest.skip("no yaml here")
    got = config.load(str(path), {"SIFTMILL_RETRIEVAL_PREFETCH": "9", "SIFTMILL_RETRIEVAL_RERANK": "false"})
    assert got.paths == ("a", "b") and got.retrieval.top_k == 7 and got.retrieval.prefetch == 9 and got.retrieval.rerank is False
    with pytest.raises(ValueError):
        config.load(None, {"SIFTMILL_CHUNKING_CHUNK_OVERLAP": "600"})
