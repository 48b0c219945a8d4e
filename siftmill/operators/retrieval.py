"""Dense, keyword and hybrid retrieval for many queries at once.

Chunks: chunk_id, file_path, header, line_start, chunk_index, text, source_sha, vector (and sparse_indices,
sparse_values where sparse scores are asked for). Queries: query_id, query, vector. Each leg filters before it ranks,
keeps N rows a query, and only these rows get the other columns of their chunks back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from siftmill.functions import text as tx
from siftmill.sources.scratch import durable

RRF_K = 60
#: Numbers in the query vectors of one block (8 bytes each): what a scan over the chunks compares with at once.
BLOCK_NUMBERS = 1_000_000
#: Similarities that a task holds at once: chunks are taken in slices of so many over the queries of the block.
SLICE_NUMBERS = 2_000_000
#: Rows up to which queries or a few hits a query are sent to all executors.
SMALL_ROWS = 100_000


def payload_filter(file_path: str = "", header: str = "", source_sha: str = "") -> Column:
    """Conjunction of exact matches; an empty value asks for nothing."""
    out = F.lit(True)
    for name, value in (("file_path", file_path), ("header", header), ("source_sha", source_sha)):
        if value:
            out = out & (F.col(name) == value)
    return out


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcasting if a count finds it small; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_topk(chunks: DataFrame, queries: DataFrame, n: int, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the n chunks with the largest cosine for each query; ties by chunk_id.

    The queries are a stated set that is compared with all chunks in blocks: a task multiplies an Arrow batch of vectors
    with a block and keeps each query's n best and their ties, so that few rows reach the ranking. Scores are rounded
    to `digits` before ranking if given. A null or zero vector has no cosine and is not found.
    """
    spark = chunks.sparkSession
    rows = chunks if where is None else chunks.where(where)
    rows = rows.where(F.col("vector").isNotNull()).select("chunk_id", "vector")
    kind = queries.schema["query_id"].dataType
    schema, key = f"query_id {kind.simpleString()}, chunk_id string, score double", to_arrow_type(kind)

    def scan(block: list[tuple[object, list[float]]]) -> DataFrame:
        names = [q for q, _ in block]
        matrix = np.array([v for _, v in block], np.float64)
        norms = np.linalg.norm(matrix, axis=1)
        shared = spark.sparkContext.broadcast((names, matrix, norms))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, norms = shared.value
            step = max(n, SLICE_NUMBERS // len(names))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    ids, column = (c.slice(lo, step) for c in batch.columns)
                    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = (vectors @ matrix.T) / np.linalg.norm(vectors, axis=1)[:, None]
                        scores /= norms[None, :]
                    if digits is not None:
                        np.round(scores, digits, out=scores)
                    query, at = [], []
                    for k in range(len(names)):
                        mine = scores[:, k]
                        some = np.flatnonzero(~np.isnan(mine))
                        if len(some) > n:
                            some = some[mine[some] >= np.partition(mine[some], len(some) - n)[len(some) - n]]
                        query.append(np.full(len(some), k))
                        at.append(some)
                    query, at = np.concatenate(query), np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array(names, key).take(pa.array(query)), ids.take(pa.array(at)), pa.array(scores[at, query])], names=["query_id", "chunk_id", "score"])

        return rows.mapInArrow(best, schema)

    found = None
    for block in query_blocks(queries):
        found = scan(block) if found is None else found.unionByName(scan(block))
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, n)


def query_blocks(queries: DataFrame) -> Iterator[list[tuple[object, list[float]]]]:
    """(query_id, vector) of the queries that have a vector, in blocks of at most BLOCK_NUMBERS numbers."""
    block: list[tuple[object, list[float]]] = []
    for q in queries.select("query_id", F.col("vector").cast("array<double>")).where(F.col("vector").isNotNull()).toLocalIterator():
        if block and (len(block) + 1) * len(q[1]) > BLOCK_NUMBERS:
            yield block
            block = []
        block.append((q[0], q[1]))
    if block:
        yield block


def ranked(hits: DataFrame, n: int | None, score: str = "score", to: str = "rank") -> DataFrame:
    """Rank 1, 2, ... in each query by score, ties by chunk_id; the first n rows if given."""
    out = hits.withColumn(to, F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_id")))
    return out if n is None else out.where(F.col(to) <= n)


def text_matches(chunks: DataFrame, queries: DataFrame, where: Column | None = None) -> DataFrame:
    """query_id, chunk_id of the chunks that have all words of the query, in any order; no words match nothing.

    Words meet in an equi-join, and a chunk's words that a query shares are counted where the chunk is read. Queries and
    chunks are never paired without a shared word. An `Index` does this without a scan (`indexed.text_matches`).
    """
    rows = chunks if where is None else chunks.where(where)
    words = F.array_distinct(tx.word_tokens(F.col("query")))
    terms = queries.select("query_id", words.alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    met = rows.select("chunk_id", F.explode(F.array_distinct(tx.word_tokens(F.col("text")))).alias("term")).join(small(terms), "term")
    return met.groupBy("query_id", "chunk_id", "n").agg(F.count("*").alias("have")).where(F.col("have") == F.col("n")).select("query_id", "chunk_id")


def first_matches(chunks: DataFrame, queries: DataFrame, n: int, where: Column | None = None) -> DataFrame:
    """query_id, chunk_id, place of each query's first n matches in the order of chunk_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return text_matches(chunks, queries, where).withColumn("place", place).where(F.col("place") <= n)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The first k matches of each query in id order, with score 0."""
    return first_matches(chunks, queries, k, where).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.col("place").alias("rank"))


def lexical_leg(chunks: DataFrame, queries: DataFrame, n: int, where: Column | None = None, scorer: str = "tf", candidates: str = "first") -> DataFrame:
    """query_id, chunk_id, place, score, rank of lexical candidates: each query's first n matches, sorted by score.

    place: the match's number in id order. `candidates` 'best' takes the n best matches instead. `scorer` is 'tf' (substring counts of the query's fields) or
    'sparse' (dot product of the sparse vectors of query and chunk).
    """
    hits = first_matches(chunks, queries, n if candidates == "first" else 2**31 - 1, where)
    # Found once, so that they go to the chunks and no text is moved.
    hits = durable(hits)
    if scorer == "tf":
        wide = chunks.select("chunk_id", "text").join(small(hits), "chunk_id").join(small(queries.select("query_id", "query")), "query_id")
        scored = wide.select("query_id", "chunk_id", "place", tx.term_frequency(F.col("query"), F.col("text")).alias("score"))
    else:
        dots = sparse_scores(chunks.join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi"), queries)
        scored = hits.join(dots, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "place", F.coalesce("score", F.lit(0.0)).alias("score"))
    return ranked(scored, n)


def sparse_scores(chunks: DataFrame, queries: DataFrame, where: Column | None = None, idf: bool = False) -> DataFrame:
    """query_id, chunk_id, score: dot products over shared indices; of a chunk's repeated index the last value counts.

    With `idf`, a query's weight is multiplied by ln(1 + (n - df + 0.5) / (df + 0.5)) of its index. The chunks are read once:
    what they share with the queries is written down, and counted and summed from there. An `Index` keeps postings
    (`indexed.sparse_topk`).
    """
    rows = chunks if where is None else chunks.where(where)
    asked = queries.select("query_id", F.explode(F.arrays_zip("sparse_indices", "sparse_values")).alias("z")).groupBy("query_id", F.col("z.sparse_indices").cast("long").alias("i")).agg(F.sum(F.col("z.sparse_values").cast("double")).alias("q"))
    postings = rows.select("chunk_id", F.posexplode(F.arrays_zip("sparse_indices", "sparse_values")).alias("at", "z")).select("chunk_id", "at", F.col("z.sparse_indices").cast("long").alias("i"), F.col("z.sparse_values").cast("double").alias("d"))
    met = postings.join(small(asked), "i").groupBy("query_id", "i", "chunk_id").agg(F.max_by("d", "at").alias("d"), F.first("q").alias("q"))
    if idf:
        met, n = durable(met), rows.count()
        df = met.groupBy("query_id", "i").agg(F.count("*").alias("df"))
        met = met.join(small(df), ["query_id", "i"]).withColumn("q", F.col("q") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("q") * F.col("d")).alias("score"))


def collapse(leg: DataFrame, chunks: DataFrame, order: str, keep_rank: str = "worst") -> DataFrame:
    """One row for each query and section: the chunk that comes first by `order`, and the section's rank.

    A section with several hits gets the rank of its worst one, as later hits overwrite earlier ones; keep_rank 'best'
    takes the best.
    """
    keyed = chunks.select("chunk_id", tx.section_key(F.col("file_path"), F.col("line_start")).alias("key")).join(small(leg), "chunk_id")
    rank = F.max("rank") if keep_rank == "worst" else F.min("rank")
    return keyed.groupBy("query_id", "key").agg(F.min_by("chunk_id", order).alias("chunk_id"), rank.alias("rank"))


def fuse(dense: DataFrame, lexical: DataFrame, k: int, key: str = "key", rrf_k: int = RRF_K, rank_base: int = 0, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best by summed reciprocal ranks 1 / (rrf_k + rank); full outer join of the legs."""
    both = dense.alias("d").join(lexical.alias("l"), ["query_id", key], "full_outer")
    part = lambda side: F.coalesce(1 / (rrf_k - rank_base + F.col(f"{side}.rank")), F.lit(0.0))
    return ranked(both.select("query_id", F.coalesce("d.chunk_id", "l.chunk_id").alias("chunk_id"), F.round(part("d") + part("l"), digits).alias("score")), k)


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, prefetch: int = 5, scorer: str = "tf", collapse_rank: str = "worst", candidates: str = "first", digits: int | None = 6) -> DataFrame:
    """Dense and lexical hits, k * prefetch of each, collapsed by section and fused. The hits of both legs are found at once and kept."""
    n = k * prefetch
    dense = durable(dense_topk(chunks, queries, n, where, digits))
    lexical = durable(lexical_leg(chunks, queries, n, where, scorer, candidates))
    return fuse(collapse(dense, chunks, "rank", collapse_rank), collapse(lexical, chunks, "place" if candidates == "first" else "rank", collapse_rank), k)


def hybrid_search_server(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, prefetch: int = 5, rrf_k: int = RRF_K, rank_base: int = 0, idf: bool = True, digits: int | None = 6) -> DataFrame:
    """Dense and sparse hits fused chunk by chunk, as a vector store does it."""
    n = k * prefetch
    dense = dense_topk(chunks, queries, n, where, digits).select("query_id", "chunk_id", "rank").withColumn("key", F.col("chunk_id"))
    scores = sparse_scores(chunks, queries, where, idf).withColumn("score", F.round("score", digits if digits is not None else 15))
    sparse = ranked(scores, n).select("query_id", "chunk_id", "rank").withColumn("key", F.col("chunk_id"))
    return fuse(dense, sparse, k, rrf_k=rrf_k, rank_base=rank_base)


def search(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, server: bool = False, **options: object) -> DataFrame:
    """Hybrid search on the store's side if the chunks have sparse vectors and `server` asks for it; else on ours."""
    if server and {"sparse_indices", "sparse_values"} <= set(chunks.columns):
        return hybrid_search_server(chunks, queries, k, where, **options)
    return hybrid_search(chunks, queries, k, where, **options)


def split_queries(queries: DataFrame) -> DataFrame:
    """One row for each fragment of a query: query_id, frag_no, query."""
    return queries.select("query_id", F.posexplode(tx.fragments(F.col("query"))).alias("frag_no", "query"))


def merge_fragments(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The best hit of each section over all fragments (query_id, frag_no, chunk_id, score), and the k best of these."""
    keyed = chunks.select("chunk_id", tx.section_key(F.col("file_path"), F.col("line_start")).alias("key")).join(small(hits), "chunk_id")
    best = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "frag_no", "chunk_id")
    one = keyed.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return ranked(one.select("query_id", "chunk_id", "score"), k)


def multi_fragment_search(chunks: DataFrame, queries: DataFrame, k: int, embed, where: Column | None = None, find: Callable[..., DataFrame] | None = None, **options: object) -> DataFrame:
    """Hybrid search of every fragment in one batch, merged by section. `embed`: Column of texts to Column of vectors.

    `find`(queries, k, where, **options) stands for the search of `chunks`, of which then only the sections are read.
    """
    # Query and fragment are told apart by both numbers, however many fragments a query has.
    parts = split_queries(queries).withColumn("frag_id", F.concat_ws(":", "query_id", "frag_no"))
    asked = parts.select(F.col("frag_id").alias("query_id"), "query").withColumn("vector", embed(F.col("query")))
    hits = (find(asked, k, where, **options) if find else search(chunks, asked, k, where, **options)).select(F.col("query_id").alias("frag_id"), "chunk_id", "score")
    named = hits.join(small(parts.select("frag_id", "query_id", "frag_no")), "frag_id").select("query_id", "frag_no", "chunk_id", "score")
    return merge_fragments(named, chunks, k)


def results(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank and the five result fields of the hits; a field that a chunk lacks is empty, or 0."""
    wide = chunks.join(small(hits), "chunk_id")
    window_text = F.col("window_text") if "window_text" in chunks.columns else F.lit("")
    fields = [F.coalesce(name, F.lit(default)).alias(name) for name, default in (("file_path", ""), ("header", ""), ("line_start", 0))]
    return wide.select("query_id", "rank", *fields, F.col("score").cast("float").alias("score"), F.coalesce(tx.display_text(window_text, F.col("text")), F.lit("")).alias("text"))
