"""What a change of the index moves and writes."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from siftmill.sources import index as ix


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_move_arrays_once_and_hold_all_postings(spark):
    deal = random.Random(1)
    rows = [(f"c{k:04}", None if k % 50 == 0 else [deal.randint(0, 9) for _ in range(n)], [float(deal.randint(-3, 5)) for _ in range(n - (k % 40 == 1 and n > 0))]) for k in range(700) for n in [deal.randint(0, 6)]]
    made = ix.sparse_blocks(spark.createDataFrame(rows, "chunk_id string, sparse_indices array<bigint>, sparse_values array<double>").repartition(3))
    assert physical(made).count("rangepartitioning") == 1 and "Aggregate" not in physical(made)
    got = {}
    for b in made.collect():
        assert b["n"] == len(b["ids"]) == len(set(b["ids"])) <= 1 << ix.RANGE_BITS and (b["most"], b["least"]) == (max(b["weights"]), min(b["weights"]))
        got |= {(b["i"], c): w for c, w in zip(b["ids"], b["weights"], strict=True)}
    assert got == {(i, c): w for c, indices, weights in rows for i, w in zip(indices or [], weights)}


def test_rows_with_distinct_keys_are_not_moved(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("chunk_id"), F.lit("x").alias("text"))
    assert "Exchange" not in physical(ix.unique_by(rows, "chunk_id"))
    assert ix.unique_by(rows.unionByName(rows), "chunk_id").count() == 100


def test_postings_are_sorted_in_bounded_runs(spark, monkeypatch):
    deal = random.Random(2)
    texts = [deal.choice([None, "", " ".join(deal.choice("ab cd ef gh ij kl".split()) for _ in range(deal.randint(1, 30))), "x" + " y" * 50]) for _ in range(300)]
    rows = spark.createDataFrame([(f"c{k * 7 % 300:03}", t) for k, t in enumerate(texts)], "chunk_id string, text string")
    expected = sorted((w, c) for c, t in rows.collect() for w in set((t or "").split()))
    made = ix.text_postings(rows)
    assert "Sort" not in physical(made) and "Exchange" not in physical(made)
    assert sorted(map(tuple, made.collect())) == expected
    monkeypatch.setattr(ix, "RUN_POSTINGS", 10)
    lists = pa.RecordBatch.from_pydict({"chunk_id": [c for c, _ in rows.collect()], "terms": [None if t is None else sorted(set(t.split())) for t in texts]})
    lists = [lists.slice(0, 0), lists.slice(0, 120), lists.slice(120)]
    runs = [[tuple(r.values()) for r in run.to_pylist()] for run in ix._term_runs(iter(lists))]
    assert all(run == sorted(run) and 0 < len(run) <= 10 for run in runs) and sorted(p for run in runs for p in run) == expected
    blocks = pa.RecordBatch.from_pydict({"chunk_id": [f"c{k:03}" for k in range(400)], "i": [[k % 3, 5 + k % 2] for k in range(400)], "w": [[float(k), 1.0] for k in range(400)]})
    monkeypatch.setattr(ix, "RUN_POSTINGS", 600)
    monkeypatch.setattr(ix.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    turned = [run.select(["i", "most", "ids"]).to_pylist() for run in ix._block_runs(iter([blocks]))]
    assert all([(b["i"], -b["most"]) for b in run] == sorted((b["i"], -b["most"]) for b in run) for run in turned) and len(turned) == 2
    assert sum(len(b["ids"]) for run in turned for b in run) == 800


def test_a_change_writes_rows_where_they_are(spark, tmp_path, monkeypatch):
    plans, save = [], ix.Index._save
    monkeypatch.setattr(ix.Index, "_save", lambda self, rows, at: plans.append((at, physical(rows))) or save(self, rows, at))
    index = ix.Index(spark, str(tmp_path))
    columns = {"chunk_id": F.col("id").cast("string"), "file_path": F.concat(F.lit("f"), F.col("id") % 7), "text": F.lit("one two")}
    index.upsert(spark.range(100).select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in index.schema.items())))
    assert [("Exchange" in plan, "Sort" in plan) for at, plan in plans if at.endswith("/rows")] == [(False, True)]
    assert {p.name.split(".", 1)[1] for p in tmp_path.glob("data/*/*/*.parquet")} <= {"zstd.parquet", "c000.zstd.parquet"}
    assert index.read().count() == 100 and index.postings(lambda c: F.col(c) == "two").count() == 100
