"""Retrieval from an index: words and sparse weights are looked up in its postings, no text is scanned.

The functions return what those of `retrieval` return for the index's live rows; `where` may use the columns of
`Index.payload`. A view, given or taken at the start, holds for the whole search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions import text as tx
from siftmill.operators import retrieval
from siftmill.operators.retrieval import ranked, small
from siftmill.sources.index import RANGE_BITS, Index, View
from siftmill.sources.scratch import durable

#: Values up to which what a search looks for is written into the scan, so that files and row groups without it are skipped.
MOST_VALUES = 2000


def chosen(values: DataFrame, column: str) -> Callable[[str], Column]:
    """A condition on a scan: the values of a column, or nothing if they are more than MOST_VALUES (the join then selects)."""
    found = [r[0] for r in values.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_VALUES + 1).collect()]
    return (lambda name: F.col(name).isin(found)) if len(found) <= MOST_VALUES else (lambda name: F.lit(True))


def _allowed(index: Index, rows: DataFrame, where: Column | None, view: View) -> DataFrame:
    """`rows` (chunk_id, ...) whose chunk meets the filter."""
    return rows if where is None else rows.join(index.payload(view).where(where).select("chunk_id"), "chunk_id", "left_semi")


def text_matches(index: Index, queries: DataFrame, where: Column | None = None, view: View | None = None) -> DataFrame:
    """query_id, chunk_id of the chunks that have all words of the query.

    The word with the fewest chunks gives the candidates; the postings of the others are only asked about these. A query
    with a word that no chunk has reads no posting.
    """
    view = view or index.view()
    one = Window.partitionBy("query_id")
    terms = queries.select("query_id", F.explode(F.array_distinct(tx.word_tokens(F.col("query")))).alias("term"))
    counted = terms.join(small(index.term_counts(chosen(terms, "term"), view)), "term", "left")
    placed = counted.withColumns({"_p": F.row_number().over(one.orderBy("df", "term")), "_n": F.count("*").over(one), "_known": F.count("df").over(one)})
    known = durable(placed.where("_n = _known").select("query_id", "term", "_p", "_n"))
    rare, others = known.where("_p = 1"), known.where("_p > 1")
    met = index.postings(chosen(rare, "term"), view).join(small(rare), "term").select("query_id", "chunk_id", "_n")
    met = _allowed(index, met, where, view)
    lone, several = met.where("_n = 1"), met.where("_n > 1")
    asked = several.join(small(others.select("query_id", "term")), "query_id")
    having = asked.join(index.postings(chosen(others, "term"), view), ["term", "chunk_id"])
    every = having.groupBy("query_id", "chunk_id").agg(F.count("*").alias("_have"), F.first("_n").alias("_n")).where(F.col("_have") == F.col("_n") - 1)
    return lone.select("query_id", "chunk_id").unionByName(every.select("query_id", "chunk_id"))


def first_matches(index: Index, queries: DataFrame, n: int, where: Column | None = None, view: View | None = None) -> DataFrame:
    """query_id, chunk_id, place of each query's first n matches in the order of chunk_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return text_matches(index, queries, where, view).withColumn("place", place).where(F.col("place") <= n)


def keyword_search(index: Index, queries: DataFrame, k: int, where: Column | None = None, view: View | None = None) -> DataFrame:
    """The first k matches of each query in id order, with score 0."""
    return first_matches(index, queries, k, where, view).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.col("place").alias("rank"))


def chunks_of(index: Index, hits: DataFrame, view: View | None = None) -> DataFrame:
    """The live rows of the hits' files: what is read for a few hits, as rows are sorted by file."""
    view = view or index.view()
    named = index.payload(view).join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return index.read(view).where(chosen(named, "file_path")("file_path"))


def sparse_topk(index: Index, queries: DataFrame, n: int, where: Column | None = None, idf: bool = True, digits: int | None = 6, view: View | None = None, told: dict | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the n chunks with the largest sparse products for each query; ties by chunk_id.

    A range of chunks can't score more than the sum of its blocks' largest products. The ranges with the largest bounds are
    scored first; the n-th best score that they give is one that the n-th best of all reaches. Then the ranges whose
    bound reaches it are read, and no others. Weights may be negative. With fewer than n scores in the first ranges, all
    ranges of that query are read. `told` gets the numbers of blocks met, and read.

    With `idf`, a query's weight is multiplied by ln(1 + (N - df + 0.5) / (df + 0.5)) of its index.
    """
    view = view or index.view()
    digits = 15 if digits is None else digits
    asked = queries.select("query_id", F.explode(F.arrays_zip(F.col("sparse_indices").alias("i"), F.col("sparse_values").alias("q"))).alias("z")).select("query_id", F.col("z.i").cast("long").alias("i"), F.col("z.q").cast("double").alias("q"))
    pick = chosen(asked, "i")
    if idf:
        total = index.point_count(view).first()["n"]
        weight = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = asked.join(small(index.sparse_counts(pick, view)), "i").select("query_id", "i", (F.col("q") * weight).alias("q"))
    asked = durable(asked)
    # A chunk of the range may lack the index: its product is then 0.
    most = F.greatest(F.col("q") * F.col("most"), F.col("q") * F.col("least"), F.lit(0.0))
    bounds = durable(index.block_bounds(pick, view).join(small(asked), "i").groupBy("query_id", "v", "range").agg(F.sum(most).alias("bound"), F.count("*").alias("blocks")))

    def scores(ranges: DataFrame) -> DataFrame:
        """Live chunks of (query_id, v, range) with their scores."""
        wanted = ranges.join(small(asked), "query_id").select("query_id", "i", "v", "range", "q")
        blocks = index.blocks(pick, view).join(small(wanted), ["i", "v", "range"])
        listed = blocks.select("query_id", "v", "q", F.explode("z").alias("p")).select("query_id", "v", F.col("p.ids").alias("chunk_id"), (F.col("q") * F.col("p.weights")).alias("s"))
        summed = listed.groupBy("query_id", "v", "chunk_id").agg(F.round(F.sum("s"), digits).alias("score"))
        return _allowed(index, index.live_postings(summed, view), where, view).select("query_id", "chunk_id", "score")

    first = -(-n >> RANGE_BITS) + 1
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "v", "range"))
    seen = ranked(scores(bounds.withColumn("_r", best).where(F.col("_r") <= first).select("query_id", "v", "range")), n)
    floor = seen.where(F.col("rank") == n).select("query_id", F.col("score").alias("_floor"))
    # Rounded scores may be a unit of the last digit above their bound.
    left = bounds.join(small(floor), "query_id", "left").where(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - 10.0**-digits - F.abs("_floor") * 1e-12))
    left = durable(left)
    if told is not None:
        total = lambda df: df.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
        told |= {"met": total(bounds), "read": total(left)}
    return ranked(scores(left.select("query_id", "v", "range")), n)


def lexical_leg(index: Index, queries: DataFrame, n: int, where: Column | None = None, scorer: str = "tf", view: View | None = None) -> DataFrame:
    """query_id, chunk_id, place, score, rank: each query's first n matches, sorted by score.

    `scorer` 'tf' counts the query's fields in the texts of the matches alone; 'sparse' sums the products of sparse weights.
    """
    view = view or index.view()
    hits = durable(first_matches(index, queries, n, where, view))
    if scorer == "tf":
        texts = chunks_of(index, hits, view).select("chunk_id", "text")
        wide = texts.join(small(hits), "chunk_id").join(small(queries.select("query_id", "query")), "query_id")
        return ranked(wide.select("query_id", "chunk_id", "place", tx.term_frequency(F.col("query"), F.col("text")).alias("score")), n)
    held = chunks_of(index, hits, view).select("chunk_id", "sparse_indices", "sparse_values").join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    dots = retrieval.sparse_scores(held, queries)
    return ranked(hits.join(dots, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "place", F.coalesce("score", F.lit(0.0)).alias("score")), n)


def hybrid_search(index: Index, queries: DataFrame, k: int, where: Column | None = None, prefetch: int = 5, scorer: str = "tf", collapse_rank: str = "worst", digits: int | None = 6, view: View | None = None) -> DataFrame:
    """Dense hits and keyword hits, k * prefetch of each, collapsed by section and fused."""
    view = view or index.view()
    n = k * prefetch
    dense = durable(retrieval.dense_topk(index.read(view), queries, n, where, digits))
    lexical = durable(lexical_leg(index, queries, n, where, scorer, view))
    sections = index.payload(view)
    return retrieval.fuse(retrieval.collapse(dense, sections, "rank", collapse_rank), retrieval.collapse(lexical, sections, "place", collapse_rank), k)


def hybrid_search_server(index: Index, queries: DataFrame, k: int, where: Column | None = None, prefetch: int = 5, rrf_k: int = retrieval.RRF_K, rank_base: int = 0, idf: bool = True, digits: int | None = 6, view: View | None = None) -> DataFrame:
    """Dense and sparse hits of the index fused chunk by chunk."""
    view = view or index.view()
    n = k * prefetch
    dense = retrieval.dense_topk(index.read(view), queries, n, where, digits)
    sparse = sparse_topk(index, queries, n, where, idf, digits, view)
    leg = lambda hits: hits.select("query_id", "chunk_id", "rank").withColumn("key", F.col("chunk_id"))
    return retrieval.fuse(leg(dense), leg(sparse), k, rrf_k=rrf_k, rank_base=rank_base)


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, server: bool = True, **options: object) -> DataFrame:
    """Hybrid search on the store's side if the index has sparse vectors, the queries have them and `server` asks for it; else on ours."""
    if server and index.has_sparse and {"sparse_indices", "sparse_values"} <= set(queries.columns):
        return hybrid_search_server(index, queries, k, where, **options)
    return hybrid_search(index, queries, k, where, **options)
