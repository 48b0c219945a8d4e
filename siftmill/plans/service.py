"""The search service as one plan over a table of requests."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import text as tx
from siftmill.operators import indexed, models, postprocess, retrieval
from siftmill.sources.config import Cache, Retrieval
from siftmill.sources.index import Index
from siftmill.sources.scratch import durable


@dataclass
class SearchService:
    """Search of an index with plain, hypothetical-document or adaptive retrieval, reranking and filtering.

    A failing reranker fails the plan; a relevance filter that fails or knows nothing keeps its hits; a query whose
    hypothetical documents all fail is searched by its fragments. Reranker and filter see the text that results show.
    `judge` rates relevance by prompts; without one, the share of shared words stands in. `generator` writes hypothetical
    documents and answers.
    """

    chunks: DataFrame
    embedder: models.Embedder
    settings: Retrieval = field(default_factory=Retrieval)
    reranker: models.Reranker | None = None
    generator: models.TextGenerator | None = None
    judge: models.TextGenerator | None = None
    #: Rates relevance by a column of its own, if there is no judge.
    relevance: models.RelevanceScorer | None = None
    #: Where the chunks are kept: words and sparse weights are then looked up in its postings.
    index: Index | None = None
    #: With it, and an index that has sparse vectors, hits are fused on the store's side.
    sparse: models.SparseEmbedder | None = None

    @classmethod
    def over(cls, index: Index, embedder: models.Embedder, **options: object) -> SearchService:
        """The service over the present state of an index."""
        return cls(index.read(), embedder, index=index, **options)

    @property
    def find(self) -> Callable[..., DataFrame] | None:
        """The hybrid search of the index; None without one."""
        if self.index is None:
            return None

        def search(queries: DataFrame, k: int, where: Column | None = None, **options: object) -> DataFrame:
            if self.sparse is not None and self.index.has_sparse:
                found = queries.withColumn("_s", models.sparse_column(self.sparse, F.col("query"), "query"))
                queries = found.withColumns({"sparse_indices": F.col("_s.indices"), "sparse_values": F.col("_s.values")}).drop("_s")
            return indexed.search(self.index, queries, k, where, server=self.sparse is not None, **options)

        return search

    def embed(self, text: Column) -> Column:
        return models.embed_column(self.embedder, text)

    def fetch(self, k: int) -> int:
        """Rows to retrieve: more than asked for if they are reranked."""
        return k * max(1, self.settings.candidate_mul) if self.reranker else k

    def search(self, queries: DataFrame, k: int | None = None, where: Column | None = None, adaptive: bool = False) -> DataFrame:
        """query_id, rank and result fields for requests (query_id, query)."""
        k = k if k and k > 0 else self.settings.top_k
        n = self.fetch(k)
        options = {"prefetch": self.settings.prefetch, "find": self.find}
        if self.settings.hyde and self.generator:
            asked = queries.withColumn("vector", self.embed(F.col("query")))
            # The answers are made once: the plan reads their vectors several times.
            hyde = durable(postprocess.hyde_vectors(queries, self.settings.hyde_docs, self.generator, self.embedder))
            if adaptive:
                hits = postprocess.adaptive_hyde_search(self.chunks, asked, n, hyde, self.settings.hyde_threshold, where, **options)
            else:
                good, bad = hyde.where(F.col("vector").isNotNull()), hyde.where(F.col("vector").isNull()).select("query_id")
                hits = postprocess.hyde_search(self.chunks, asked.join(good.select("query_id"), "query_id", "left_semi"), n, good, where, **options)
                plain = retrieval.multi_fragment_search(self.chunks, queries.join(bad, "query_id", "left_semi"), n, self.embed, where, **options)
                hits = hits.select(*postprocess.HITS).unionByName(plain.select(*postprocess.HITS))
        else:
            hits = retrieval.multi_fragment_search(self.chunks, queries, n, self.embed, where, **options)
        return self.finish(hits, queries, k)

    def keyword(self, queries: DataFrame, k: int | None = None, where: Column | None = None) -> DataFrame:
        k = k if k and k > 0 else self.settings.top_k
        hits = indexed.keyword_search(self.index, queries, self.fetch(k), where) if self.index else retrieval.keyword_search(self.chunks, queries, self.fetch(k), where)
        return self.finish(hits, queries, k)

    def answer(self, queries: DataFrame, k: int | None = None, where: Column | None = None, max_tokens: int = 2048) -> DataFrame:
        """query_id, answer from the results of a search, which never come from a cache; a query without results has no row."""
        if self.generator is None:
            raise ValueError("answers need a generator")
        return postprocess.answers(self.search(queries, k, where), queries, self.generator, max_tokens)

    def cached_search(self, queries: DataFrame, cache: Index, settings: Cache = Cache(), k: int | None = None, where: Column | None = None, now: Column | None = None) -> DataFrame:
        """`search` behind a cache (an `Index` of RESULT_CACHE rows by id), which then also holds the lists of the queries it did not know.

        A known query gets the first k of its cached results, whatever `where` says: entries are told apart by the query
        alone. Lists are written first and results read from there, so that they are searched once. `now` is a constant.
        """
        k = k if k and k > 0 else self.settings.top_k
        if not settings.enabled:
            return self.search(queries, k, where)
        now = F.timestamp_seconds(F.lit(int(time.time()))) if now is None else now
        asked = queries.select("query_id", "query").withColumn("vector", self.embed(F.col("query")))
        held = cache.read()
        hits = postprocess.cache_lookup(held, asked, now, settings.threshold, settings.ttl_seconds).select("query_id", "cache_id")
        missed = asked.join(hits, "query_id", "left_anti")
        cache.upsert(postprocess.result_entries(missed, self.search(missed.select("query_id", "query"), k, where), now))
        made = missed.select("query_id", tx.uuid5(tx.CACHE_NAMESPACE, F.col("query")).alias("cache_id"))
        lists = lambda which, rows: which.join(rows.select(F.col("id").alias("cache_id"), F.slice("results", 1, k).alias("r")), "cache_id").select("query_id", F.inline("r"))
        return lists(hits, held).unionByName(lists(made, cache.read().where(F.col("cached_at") == F.date_trunc("second", now))))

    def finish(self, hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        if self.reranker or self.settings.chunk_filter:
            window = F.col("window_text") if "window_text" in self.chunks.columns else F.lit("")
            text = self.chunks.select("chunk_id", tx.display_text(window, F.col("text")).alias("text"))
            wide = text.join(retrieval.small(hits.select("query_id", "chunk_id", "score", "rank")), "chunk_id").join(retrieval.small(queries.select("query_id", "query")), "query_id")
            if self.reranker:
                wide = postprocess.rerank(models.rerank_groups(wide.drop("score"), self.reranker), k, F.col("score"))
            if self.settings.chunk_filter:
                threshold = self.settings.filter_threshold
                rated = (self.relevance.column if self.relevance else models.overlap_score)(F.col("query"), F.col("text"))
                wide = postprocess.model_filter(wide, self.judge, threshold) if self.judge else postprocess.relevance_filter(wide, rated, threshold)
            hits = wide.select("query_id", "chunk_id", "score", "rank")
        return retrieval.results(hits.select("query_id", "chunk_id", "score", "rank"), self.chunks)


def checked_requests(requests: DataFrame, default_k: int = 5) -> DataFrame:
    """The requests with a positive top_k, and `error`: why a request is rejected, null for those that are searched."""
    empty = (F.coalesce("query", F.lit("")) == "") & (F.coalesce("keyword", F.lit("")) == "")
    return requests.withColumns({"top_k": F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(default_k), "error": F.when(empty, "a request needs a query or a keyword")})


def valid_requests(requests: DataFrame, default_k: int = 5) -> DataFrame:
    """Requests with a query or a keyword, with a positive top_k; the others are rejected one by one (`checked_requests`)."""
    return checked_requests(requests, default_k).where(F.col("error").isNull()).drop("error")


def to_json(results: DataFrame) -> DataFrame:
    """query_id, json: the results of each query as one JSON array in rank order."""
    row = F.struct("rank", "file_path", "header", "line_start", "score", "text")
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return listed.select("query_id", F.to_json(F.transform("_r", lambda r: r.dropFields("rank"))).alias("json"))
