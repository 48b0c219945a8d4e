"""The cache of a stream: what it answers, and that expired entries leave the store."""

import pytest
from pyspark.sql import functions as F

from siftmill.streaming.request_cache import ROCKS, cached_answers

#: (query, second, results): results store, None asks. Each inner list is one file, and so one batch.
BATCHES = [
    [("a", 0, "r1"), ("b", 5, "s1"), ("a", 0, None), ("c", 3, None)],
    [("a", 60, None), ("b", 66, None), ("a", 61, "r2"), ("a", 61, None)],
    [("a", 100, None), ("b", 100, "s2")],
    [("x", 400, None), ("a", 399, None)],
    [("b", 500, None)],
]


def expected(ttl):
    held, out = {}, []
    for batch in BATCHES:
        for query, at, results in sorted(batch, key=lambda e: (e[1], e[2] is None)):
            if results is not None:
                held[query] = (results, at)
            else:
                found = held.get(query)
                out.append((query, at, found[0] if found and (not ttl or at - found[1] <= ttl) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ttl", [60, 0])
def test_answers_and_forgetting(spark, tmp_path, ttl):
    pytest.importorskip("google.protobuf", reason="Spark's state server speaks protobuf")
    source = tmp_path / "in"
    source.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for k, batch in enumerate(BATCHES):
            spark.createDataFrame(batch, "query string, second long, results string").coalesce(1).write.json(str(tmp_path / f"b{k}"))
            next((tmp_path / f"b{k}").glob("*.json")).rename(source / f"{k}.json")
            events = spark.readStream.schema("query string, second long, results string").json(str(source)).select("query", F.timestamp_seconds(F.col("second") + 1000).alias("at"), "results")
            run = cached_answers(events, ttl, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            run.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).select("query", (F.unix_timestamp("at") - 1000).alias("at"), "results").collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(ttl)
        rows = run.lastProgress["stateOperators"][0]["numRowsTotal"]
        held = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp")).count()
        assert held == (0 if ttl else 2), rows
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
