"""A training-data pipeline over `documents`: quality, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import durable, table
from siftmill.llm.decontaminate import contaminated
from siftmill.llm.mixing import mix, word_count
from siftmill.llm.near_dedup import near_duplicates
from siftmill.llm.quality import resample
from siftmill.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS, SHARDS
from siftmill.llm.sharding import shard_documents

#: The pipeline as a whole is a sequence of jobs with thresholds that follow the data: SQL cannot state its first stages.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling takes: text unlike the rows labelled good goes.

    Null, empty and blank texts have weight 0; very long ones are read whole. Repeated rows, and other rows that share a
    key, stay together if one of them is taken. A row with a null doc_id goes. Without labels nothing stays; an empty table gives no rows.
    """
    kept = resample(docs, table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0))
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: shingles of five words, similarity 0.8 and more.

    Null and empty texts and rows with a null doc_id are copies of nothing and stay. Repeated rows of one doc_id count as
    one document and stay together. Very long texts count whole; an empty table gives no rows.
    """
    kept = near_duplicates(docs, width=5, percent=80).where("kept")
    return docs.join(kept.select("doc_id").distinct(), docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark.

    Of rows that share a doc_id, null included, all go if one has a passage. Null and empty texts have none; very long ones
    are searched whole; repeated rows are treated alike. An empty table, or an empty benchmark, takes nothing away.
    """
    hits = durable(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_hit"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, so that sources reach their target weights.

    A null source is a source, a null or empty text has size 0, a null doc_id hashes like an empty one. Rows that share
    source and doc_id are taken alike, one by one. An empty table gives no rows; columns keep their names whatever they are.
    """
    taken = mix(docs, word_count(F.col("text")), MIX_WEIGHTS, MIX_SHARE, MIX_MOST).select(F.col("doc_id").alias("_i"), F.col("source").alias("_o"), F.col("copies").alias("_n")).where("_n > 0").distinct()
    same = docs["doc_id"].eqNullSafe(taken["_i"]) & docs["source"].eqNullSafe(taken["_o"])
    # A struct keeps the row's columns apart from those that are added here.
    row = docs.join(taken, same).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.explode(F.sequence(F.lit(1), taken["_n"].cast("int"))))
    return row.select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row.

    A null doc_id goes where 0 goes; a null text has size 1; rows that share a doc_id share a shard and have slots of their
    own. Very long texts are only measured; an empty table gives no rows.
    """
    return shard_documents(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written once and reread as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
