"""Markdown files that keep arriving in a folder, brought into the index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftmill.functions import text as tx
from siftmill.operators import models
from siftmill.plans.ingest import ingest
from siftmill.sources import files as fl
from siftmill.sources.config import Chunking
from siftmill.sources.index import Index


def stream_files(spark: SparkSession, folder: str, index: Index, embedder: models.Embedder, checkpoint: str, chunking: Chunking = Chunking(), ignore: list[str] = (), sparse: models.SparseEmbedder | None = None) -> StreamingQuery:
    """Ingest what is in the folder now and stop; a later call goes on after the files of the checkpoint.

    Files have the paths that `list_markdown` gives them, so that both fill one index. Hidden files and those of length 0 are left
    out, as by Spark's file stream; a file that was changed since is read again. A batch that is repeated after a failure finds its
    files unchanged or writes the same chunk ids again.

    Spark's file stream holds every file's status and path on the driver. Here tasks list the folder, the names that are new
    are added to a table in the checkpoint, and the stream is that of the table: the driver holds the table's few parts, and tasks
    read the files. A store that pyarrow doesn't know is left to Spark's file stream.
    """
    root = fl.qualified(spark, folder)
    if not fl.lists_names(root):
        return _own_stream(spark, folder, index, embedder, checkpoint, chunking, ignore, sparse)
    arrived = f"{checkpoint}/arrived"
    names = fl.list_names(spark, root).where(~fl.ignored(F.col("path"), list(ignore)))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(arrived)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        names = names.join(spark.read.schema(fl.NAMES).parquet(arrived).select("path", "modified"), ["path", "modified"], "left_anti")
    # Part of a write that did not come to an end is names that arrived.
    names.select("path", "bytes", "modified").repartition("path").write.mode("append").parquet(arrived)

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(fl.read_names(batch, root), index, embedder, chunking, sparse=sparse)

    rows = spark.readStream.schema(fl.NAMES).parquet(arrived)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _own_stream(spark: SparkSession, folder: str, index: Index, embedder: models.Embedder, checkpoint: str, chunking: Chunking, ignore: list[str], sparse: models.SparseEmbedder | None) -> StreamingQuery:
    """`stream_files` by Spark's file stream, whose driver holds what it lists."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(folder)
    relative = fl.relative_path(spark, F.col("path"), folder)
    rows = files.select(relative.alias("path"), tx.content_sha(F.col("content")).alias("sha"), F.decode("content", "UTF-8").alias("content")).where(~fl.ignored(F.col("path"), list(ignore)))

    def write(batch: DataFrame, _: int) -> None:
        ingest(batch, index, embedder, chunking, sparse=sparse)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
