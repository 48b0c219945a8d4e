"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm.common import bucket_hash, n_bytes

#: Rows that one sorted slot bucket holds on average.
SLOT_ROWS = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys: each step draws the next shard count at which the key would move."""
    if shards < 1:
        raise ValueError("a key needs at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    while len(active):
        shard[active] = jump[active]
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[active] = np.floor((shard[active] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        active = active[jump[active] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a long key; a null key counts as 0."""

    @F.pandas_udf("int")
    def jumped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return jumped(F.coalesce(key.cast("long"), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Put rows into shards by their key alone, and give each row a slot in its shard.

    Adds to the key: size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 (null text: that of no bytes), law
    ('key'), shard, slot (0, 1, ... without gaps in each shard) and grown_shard (the shard if one more is appended; a
    row stays or moves into the new one). A null key goes where 0 goes; rows with the same key share a shard and have
    slots of their own. Empty tables give no rows.

    Slots: rows of a shard are dealt to buckets by the key's hash, numbered in each bucket, and shifted by the rows of
    the buckets before; a bucket has about `slot_rows` rows, so no task sorts a shard. Rows with one and the same key
    fall into one bucket and are told apart by size and checksum.
    """
    base = docs.select(
        F.col(key).alias("doc_id"),
        (n_bytes(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"),
    )
    rows = docs.count()
    buckets = max(1, -(-rows // (slot_rows * shards)))
    placed = base.withColumns(
        {
            "law": F.lit("key"),
            "shard": shard_of(F.col("doc_id"), shards),
            "grown_shard": shard_of(F.col("doc_id"), shards + 1),
            "_h": bucket_hash(F.col("doc_id")),
        }
    ).withColumn("_b", (F.col("_h") % buckets).cast("int"))
    counts = placed.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("shard", "_b", F.coalesce(before, F.lit(0)).alias("_shift"))
    order = Window.partitionBy("shard", "_b").orderBy("_h", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("_r", F.row_number().over(order) - 1)
        .join(shifts, ["shard", "_b"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_shift") + F.col("_r")).cast("long").alias("slot"), "grown_shard")
    )
