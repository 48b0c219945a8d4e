"""What the operators share: reading tables, durable intermediate results and argument checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """`df` written once to the folder of spark.checkpoint.dir, which all executors share.

    A folder is chosen here only where the session names none and runs on one machine, as in tests; a cluster's other
    machines could not read it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftmill-checkpoint-"))
    return df.checkpoint(eager=True)


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bucket_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text, as a long from 0 to 2**60 - 1; null counts as an empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


#: Rows up to which a table of a few narrow columns is sent to every executor; at 100 bytes a row, 10 MB.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcasting if a count finds it under the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
