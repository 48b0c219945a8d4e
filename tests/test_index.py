"""The index against a plain dictionary: merging on read, the manifest, postings, conflicts, compaction."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from siftmill.operators import indexed, models, retrieval
from siftmill.plans.ingest import ingest
from siftmill.plans.service import SearchService
from siftmill.sources import config
from siftmill.sources.index import Index, file_shas, lookup_sha, point_count
from siftmill.sources.versions import Conflict, VersionLog

ROWS = "chunk_id string, file_path string, header string, line_start int, chunk_index int, text string, window_text string, source_sha string, vector array<float>"
SPARSE = ROWS + ", sparse_indices array<bigint>, sparse_values array<float>"
WORDS = ["apple", "plum", "pear", "the", "of", "and", "window", "Übung"]


def row(name, file, text, sha="s", vector=(1.0, 0.0)):
    return (name, file, "h", 1, 0, text, "", sha, list(vector))


def texts_of(index):
    return {r["chunk_id"]: r["text"] for r in index.read().collect()}


def plain(rows):
    return sorted(map(str, rows.collect()))


def random_rows(rng, files, n, sha):
    return [row(f"{f}-{k}", f, " ".join(rng.choices(WORDS, [1, 1, 1, 9, 9, 5, 2, 1], k=rng.randrange(1, 9))), sha, [rng.random(), rng.random() - 0.3]) for f in files for k in range(rng.randrange(1, n))]


def with_sparse(rows):
    out = []
    for r in rows:
        words = (r[5] or "").lower().split()
        ids = sorted({WORDS.index(w) if w in WORDS else 99 for w in words})
        out.append((*r, ids, [float(sum(WORDS.index(w) == i if w in WORDS else i == 99 for w in words)) + 0.1 * i for i in ids]))
    return out


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """An index after a base, upserts, deletions, replacements and a deletion with a new row; and the same rows merged in Python."""
    index, rng, held = Index(spark, str(tmp_path_factory.mktemp("idx") / "i")), random.Random(5), {}

    def change(rows=None, gone=(), sparse=True):
        made = spark.createDataFrame(with_sparse(rows) if sparse else rows, SPARSE if sparse else ROWS) if rows is not None else None
        index.change(made, spark.createDataFrame([(g,) for g in gone], "file_path string") if gone else None)
        for name in [k for k, r in held.items() if r[1] in gone]:
            del held[name]
        held.update({r[0]: r for r in with_sparse(rows or [])})

    change(random_rows(rng, [f"f{k}" for k in range(30)], 9, "one"))
    change(random_rows(rng, ["f1", "f2", "f40"], 9, "two"))
    change(gone=("f3", "f4", "none"))
    change(random_rows(rng, ["f5", "f3"], 5, "three"), ("f5", "f6"))
    change(random_rows(rng, ["f1"], 3, "four"))
    return index, held


def test_merged_rows_manifest_and_counts(spark, changed):
    index, held = changed
    rows = index.read()
    assert {r["chunk_id"]: (r["text"], r["source_sha"], r["sparse_indices"]) for r in rows.collect()} == {k: (r[5], r[7], r[9]) for k, r in held.items()}
    assert rows.count() == len(held) == index.point_count().first()["n"] == point_count(rows).first()["n"]
    assert plain(index.file_shas().select("file_path", "source_sha")) == plain(file_shas(rows).select("file_path", "source_sha"))
    wanted = spark.createDataFrame([("f1",), ("f6",), ("f3",), ("none",)], "file_path string")
    assert plain(index.lookup_sha(wanted)) == plain(lookup_sha(rows, wanted))
    # Neither reads rows.
    for frame in (index.file_shas(), index.lookup_sha(wanted)):
        assert not any("/rows/" in f for f in frame.inputFiles())


QUERIES = [(0, "apple the"), (1, "of"), (2, "the of and"), (3, "zebra the"), (4, "?"), (5, "ÜBUNG"), (6, "plum pear apple"), (7, "The the")]


def queries_of(spark):
    rows = [(q, t, [1.0, 0.2 * q], *with_sparse([row("", "", t)])[0][9:]) for q, t in QUERIES]
    return spark.createDataFrame(rows, "query_id long, query string, vector array<float>, sparse_indices array<bigint>, sparse_values array<float>")


@pytest.mark.parametrize("where", [None, "f1"])
def test_index_finds_what_a_scan_finds(spark, changed, where):
    index, _ = changed
    rows, queries = index.read(), queries_of(spark)
    cond = None if where is None else F.col("file_path").isin("f1", "f7", "f12", "f3")
    assert plain(indexed.keyword_search(index, queries, 7, cond)) == plain(retrieval.keyword_search(rows, queries, 7, cond))
    for scorer in ("tf", "sparse") if where is None else ():
        order = ["query_id", "chunk_id", "place", "score", "rank"]
        assert plain(indexed.lexical_leg(index, queries, 9, cond, scorer).select(order)) == plain(retrieval.lexical_leg(rows, queries, 9, cond, scorer).select(order))
    assert plain(indexed.hybrid_search(index, queries, 3, cond)) == plain(retrieval.hybrid_search(rows, queries, 3, cond))
    for idf in (True, False) if where is None else (True,):
        # df counts all live rows, whatever the filter.
        scores = retrieval.sparse_scores(rows, queries, None, idf).join(rows.where(cond).select("chunk_id") if cond is not None else rows.select("chunk_id"), "chunk_id", "left_semi")
        want = retrieval.ranked(scores.select("query_id", "chunk_id", F.round("score", 6).alias("score")), 6)
        assert plain(indexed.sparse_topk(index, queries, 6, cond, idf)) == plain(want)
    if cond is None:
        assert plain(indexed.search(index, queries, 3)) == plain(retrieval.hybrid_search_server(rows, queries, 3))


def test_plans_scan_no_text(spark, changed):
    index, _ = changed
    found = indexed.keyword_search(index, queries_of(spark), 5)
    assert not any("/rows/" in f for f in found.inputFiles()) and any("/terms/" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().toString()
    assert "window_text" not in plan and "In(term" in plan.replace("PushedFilters: [In(term", "In(term")
    told = {}
    indexed.sparse_topk(index, queries_of(spark), 3, told=told)
    assert told["read"] <= told["met"]


def test_fewer_blocks_are_read_for_fewer_results(spark, tmp_path):
    index, rng = Index(spark, str(tmp_path / "i")), random.Random(2)
    rows = [(*row(f"c{k:05}", f"f{k % 50}", "x"), [1, 2], [float(rng.paretovariate(1)), float(rng.paretovariate(1))]) for k in range(6000)]
    index.upsert(spark.createDataFrame(rows, SPARSE))
    queries = spark.createDataFrame([(0, [1, 2], [1.0, 1.0])], "query_id long, sparse_indices array<bigint>, sparse_values array<float>")
    read = {}
    for k in (1, 50, 1000):
        told = {}
        got = indexed.sparse_topk(index, queries, k, idf=False, told=told).collect()
        best = sorted(((-round(sum(float(F32(x)) for x in r[10]), 6), r[0]) for r in rows))[:k]
        assert [(r["score"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(-s, c) for s, c in best]
        read[k] = told["read"]
        assert told["met"] > 80
    assert read[1] <= read[50] < read[1000] < told["met"] and read[1] < told["met"] / 10


def F32(x):
    import numpy as np

    return np.float32(x)


def test_negative_weights_and_empty_index(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(0, "apple", [1.0, 0.0], [1, 2], [-1.0, 2.0])], "query_id long, query string, vector array<float>, sparse_indices array<bigint>, sparse_values array<float>")
    assert indexed.keyword_search(index, queries, 3).count() == 0 and indexed.sparse_topk(index, queries, 3).count() == 0
    assert index.read().count() == 0 and not index.has_sparse and index.compact() and index.vacuum() == 0
    rows = [(*row(f"c{k:03}", "f", "x"), [1, 2], [float(k % 7 - 3), float(k % 5 - 2)]) for k in range(400)]
    index.upsert(spark.createDataFrame(rows, SPARSE))
    got = [(r["score"], r["chunk_id"]) for r in indexed.sparse_topk(index, queries, 20, idf=False).orderBy("rank").collect()]
    assert got == [(-s, c) for s, c in sorted((-(2 * r[10][1] - r[10][0]), r[0]) for r in rows)[:20]]


def test_bytes_written_follow_the_change(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "i").rglob("*") if p.is_file())
    rng = random.Random(1)
    index.upsert(spark.createDataFrame([row(f"c{k}", f"f{k % 700}", "".join(rng.choices("abcdefgh ", k=900))) for k in range(2000)], ROWS))
    before = size()
    index.upsert(spark.createDataFrame([row(f"c{k}", f"f{k}", "new") for k in range(200)], ROWS))  # 200 files
    assert size() - before < before / 10
    assert sum(t == "new" for t in texts_of(index).values()) == 200


def test_versions_compaction_vacuum_and_old_views(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), most_deltas=3)
    for k in range(5):
        index.upsert(spark.createDataFrame([row("a", "f", f"t{k}"), row(f"b{k}", "g", "x")], ROWS))
        if k == 1:
            old = index.view()
    assert texts_of(index) == {"a": "t4"} | {f"b{k}": "x" for k in range(5)}
    assert any(e["base"] for v, e in index.view().versions if v)
    assert {r["text"] for r in index.read(old).where("chunk_id = 'a'").collect()} == {"t1"}
    assert index.vacuum(3600) == 0
    index.compact()
    last = index.view().last
    assert len(index.view().versions) == 1 and index.vacuum(-3600) > 0 and len(texts_of(index)) == 6
    assert index.view().last == last and len(list((tmp_path / "i" / "log").glob("*.json"))) == 1
    assert index.change(spark.createDataFrame([], ROWS)) is None and index.delete_files(spark.createDataFrame([("none",)], "file_path string")) is None
    assert index.change(spark.createDataFrame([row("x", None, "t")], ROWS), spark.createDataFrame([("f",)], "file_path string")) is not None
    assert texts_of(index) == {"x": "t"} | {f"b{k}": "x" for k in range(5)}


def test_data_without_an_entry_are_not_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.upsert(spark.createDataFrame([row("a", "f", "t")], ROWS))
    spark.createDataFrame([row("b", "f", "t")], ROWS).write.parquet(f"{index.path}/data/lost/rows")
    assert texts_of(index) == {"a": "t"} and index.vacuum(-3600) == 1


def test_two_writers_both_come_in_or_one_raises(spark, tmp_path):
    first, second = (Index(spark, str(tmp_path / "i")) for _ in range(2))
    first.upsert(spark.createDataFrame([row("a", "f", "0"), row("z", "gone", "0")], ROWS))
    seen = first.view().last
    wait, failed = threading.Barrier(2), []

    def write(index, name):
        try:
            plain_view, calls = index.view, []

            def view():
                out = plain_view()
                if not calls:
                    calls.append(1)
                    wait.wait(60)  # both have seen the same version
                return out

            index.view = view
            index.change(spark.createDataFrame([row(name, "f", name), row("a", "f", name)], ROWS), spark.createDataFrame([("gone",)], "file_path string"))
        except Exception as e:  # pragma: no cover
            failed.append(e)

    threads = [threading.Thread(target=write, args=x) for x in ((first, "b"), (second, "c"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed
    index = Index(spark, first.path)
    assert index.view().last == seen + 2
    got = texts_of(index)
    assert got.keys() == {"a", "b", "c"} and got["a"] in "bc"
    with pytest.raises(Conflict):
        index.change(spark.createDataFrame([row("d", "f", "d")], ROWS), expected=seen)
    assert texts_of(index).keys() == {"a", "b", "c"}


@pytest.mark.parametrize("how", ["_link", "_rename"])
def test_a_number_is_given_once(spark, tmp_path, how):
    log = VersionLog(spark, str(tmp_path / "log"))
    assert log.last() == -1
    add = (lambda n, e: log._link(log.folder, log._name(n), e)) if how == "_link" else (lambda n, e: log._rename(f"{log.folder}/{log._name(n)}", e))
    assert add(0, '{"x": "é"}') and not add(0, '{"x": 2}') and add(1, '{"x": 3}')
    assert log.last() == 1 and log.read(0) == {"x": "é"} and log.read(1) == {"x": 3}
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json") == ["00000000.json", "00000001.json"] and not list((tmp_path / "log").glob(".*.tmp"))


def test_ingest_with_sparse_vectors_is_searched_in_the_store(spark, tmp_path):
    index, embedder, sparse = Index(spark, str(tmp_path / "i")), models.HashEmbedder(16), models.HashSparseEmbedder()
    files = lambda *rows: spark.createDataFrame(rows, "path string, sha string, content string")
    assert ingest(files(("a.md", "1", "# A\n\nripe apple"), ("e.md", "1", "")), index, embedder) == {"processed": 2, "skipped": 0, "failed": 0}
    assert not index.has_sparse and "sparse_indices" not in index.read().columns
    assert ingest(files(("a.md", "1", "# A\n\nripe apple"), ("b.md", "1", "# B\n\nred plum\n\n# C\n\nripe plum")), index, embedder, sparse=sparse) == {"processed": 1, "skipped": 1, "failed": 0}
    assert index.has_sparse and index.read().where("sparse_indices is null").count() == 1
    queries = spark.createDataFrame([(0, "ripe plum"), (1, "apple")], "query_id long, query string")
    run = SearchService.over(index, embedder, settings=config.Retrieval(), sparse=sparse)
    got = run.search(queries, 3).collect()
    assert [r["header"] for r in got if r["query_id"] == 0 and r["rank"] == 1] == ["C"]
    asked = queries.withColumn("vector", models.embed_column(embedder, F.col("query"))).withColumn("_s", models.sparse_column(sparse, F.col("query"), "query")).withColumns({"sparse_indices": F.col("_s.indices"), "sparse_values": F.col("_s.values")})
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in indexed.search(index, asked, 3).collect()) == sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in retrieval.hybrid_search_server(index.read(), asked, 3).collect())
    local = SearchService.over(index, embedder)
    assert plain(local.search(queries, 3)) == plain(SearchService(index.read(), embedder).search(queries, 3))
    assert [r["header"] for r in local.keyword(queries, 3).where("query_id = 1").collect()] == ["A"]
    # A file that is emptied loses its chunks in replace mode; two entries of one path count as two.
    two = spark.createDataFrame([("b.md", "x", "2", ""), ("b.md", "y", "2", "")], "path string, root string, sha string, content string")
    assert ingest(two, index, embedder, mode="replace") == {"processed": 2, "skipped": 0, "failed": 0}
    assert {r["file_path"] for r in index.read().collect()} == {"a.md"}
