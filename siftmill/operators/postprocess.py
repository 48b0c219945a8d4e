"""What happens to retrieved rows: reranking, relevance filtering, prompt assembly, hypothetical documents, the cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions import text as tx
from siftmill.functions import vectors as vx
from siftmill.operators import models
from siftmill.operators.retrieval import dense_topk, ranked, search, small
from siftmill.sources.scratch import durable

HITS = ["query_id", "chunk_id", "score", "rank"]


def rerank(hits: DataFrame, k: int, score: Column) -> DataFrame:
    """Hits with `score` in place of their own, sorted by it, the first k of each query."""
    return ranked(hits.withColumn("score", score.cast("double")).drop("rank"), k)


def relevance_filter(hits: DataFrame, relevance: Column, threshold: float = 0.5) -> DataFrame:
    """Hits whose relevance reaches the threshold, in the order they had.

    A query of which no hit reaches it, or whose relevance is unknown (null) for a hit, keeps all its hits.
    """
    one = Window.partitionBy("query_id")
    scored = hits.withColumn("_rel", relevance).withColumn("_keep", F.count_if(F.col("_rel") >= threshold).over(one)).withColumn("_bad", F.count_if(F.col("_rel").isNull()).over(one))
    return scored.where((F.col("_keep") == 0) | (F.col("_bad") > 0) | (F.col("_rel") >= threshold)).drop("_rel", "_keep", "_bad")


def filter_by_replies(hits: DataFrame, replies: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`relevance_filter` by one reply for each query, a JSON array with a number for each hit in rank order.

    A reply that does not parse, or has another length, keeps all hits of its query.
    """
    one = Window.partitionBy("query_id")
    parsed = hits.join(replies.select("query_id", tx.filter_scores(F.col("reply")).alias("_s")), "query_id", "left").withColumn("_n", F.count("*").over(one))
    place = F.row_number().over(one.orderBy("rank"))
    value = F.when(F.size("_s") == F.col("_n"), F.try_element_at("_s", F.col("_p")))
    return relevance_filter(parsed.withColumn("_p", place), value, threshold).drop("_s", "_n", "_p")


#: Fixed value: the instructions of the relevance filter.
FILTER_PROMPT = (
    "You are a retrieval filter for a knowledge base.\n\n"
    "Query: %s\n\n"
    "Rate each passage for relevance to the query.\n"
    "Return ONLY a JSON array of numbers between 0 and 1, one per passage, in order.\n"
    "Example for 3 passages: [0.9, 0.1, 0.7]\n\n"
    "Passages:\n%s"
)


def filter_prompts(hits: DataFrame) -> DataFrame:
    """query_id, prompt: one prompt for each query with its hits (query_id, query, rank, text), numbered by rank from 1."""
    head, middle, tail = FILTER_PROMPT.split("%s")
    # A query's hits are the few that a search returns.
    listed = hits.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_p"))
    passages = F.array_join(F.transform("_p", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["text"], F.lit("")), F.lit("\n\n"))), "")
    return listed.select("query_id", F.concat(F.lit(head), F.coalesce("query", F.lit("")), F.lit(middle), passages, F.lit(tail)).alias("prompt"))


def model_filter(hits: DataFrame, model: models.TextGenerator, threshold: float = 0.5) -> DataFrame:
    """Hits (query_id, query, rank, text, ...) whose relevance a model rates at the threshold or above, by one prompt for each query.

    A query for which the model fails or gives no fitting array, or of which no hit is left, keeps all its hits.
    """
    replies = filter_prompts(hits).select("query_id", models.generate_column(model, F.col("prompt")).alias("reply"))
    return filter_by_replies(hits, replies, threshold)


def prompt_order(hits: DataFrame) -> DataFrame:
    """Add `place`, where the best hits stand at both ends, and `n`, the hits of the query."""
    return hits.withColumn("n", F.count("*").over(Window.partitionBy("query_id")).cast("int")).withColumn("place", tx.middle_order(F.col("n"), F.col("rank").cast("int") - 1))


def rag_entries(hits: DataFrame, budget: int) -> DataFrame:
    """query_id, place, entry of the numbered sources that fit into `budget` bytes.

    hits: query_id, rank, file_path, text. The first entry that does not fit is cut and ends with dots if more than 60
    bytes are left, and nothing follows it. Cuts fall between characters.
    """
    entry = F.concat(F.lit("["), (F.col("place") + 1).cast("string"), F.lit("] (source: "), F.col("file_path"), F.lit(")\n"), F.col("text"), F.lit("\n\n"))
    upto = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    made = prompt_order(hits).withColumn("entry", entry).withColumn("_cum", F.sum(F.octet_length("entry")).over(upto)).withColumn("_left", budget - (F.col("_cum") - F.octet_length("entry")))
    first = F.min(F.when(F.col("_cum") > budget, F.col("place"))).over(Window.partitionBy("query_id"))
    cut = F.concat(tx.clip_utf8(F.col("entry"), (F.col("_left") - 3).cast("int")), F.lit("..."))
    kept = made.withColumn("_first", first).withColumn("entry", F.when(F.col("_cum") <= budget, F.col("entry")).when((F.col("place") == F.col("_first")) & (F.col("_left") > 60), cut))
    return kept.where((F.col("_first").isNull() | (F.col("place") <= F.col("_first"))) & F.col("entry").isNotNull()).select("query_id", "place", "entry")


def rag_context(hits: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """query_id, context: the entries in prompt order, four bytes counted as a token."""
    entries = rag_entries(hits, 4 * max_tokens)
    return entries.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda s: s["entry"]), "").alias("context"))


#: Fixed value: the instructions of the answer prompt.
ANSWER_PROMPT = (
    "You are a precise assistant. Answer the question using ONLY the context below.\n"
    'If the answer is not in the context, say "I don\'t know based on the provided context."\n'
    "Cite sources inline as [1], [2], etc. when referencing specific context sections.\n\n"
    "Context:\n%s\n\nQuestion: %s\n\nAnswer:"
)


def rag_prompt(context: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt of every query; one without sources has an empty context."""
    head, middle, tail = ANSWER_PROMPT.split("%s")
    both = queries.select("query_id", "query").join(context, "query_id", "left")
    return both.select("query_id", F.concat(F.lit(head), F.coalesce("context", F.lit("")), F.lit(middle), F.col("query"), F.lit(tail)).alias("prompt"))


def answers(hits: DataFrame, queries: DataFrame, generator: models.TextGenerator, max_tokens: int = 2048) -> DataFrame:
    """query_id, answer of the queries with hits (query_id, rank, file_path, text); null where the generator failed."""
    context = rag_context(hits, max_tokens)
    prompts = rag_prompt(context, queries.join(context.select("query_id"), "query_id", "left_semi"))
    return prompts.select("query_id", models.generate_column(generator, F.col("prompt")).alias("answer"))


def hyde_vectors(queries: DataFrame, n: int, generator: models.TextGenerator, embedder: models.Embedder, several: bool = False) -> DataFrame:
    """query_id, query, vector: the unit mean of the vectors of n hypothetical answers.

    Answers that could not be made are left out; a query without any answer has a null vector.
    """
    prompts = models.hyde_prompts(queries.select("query_id", "query"), n, several)
    made = prompts.withColumn("answer", models.generate_column(generator, F.col("prompt"))).where(F.col("answer").isNotNull())
    vectors = made.select("query_id", models.embed_column(embedder, F.col("answer")).alias("vector"))
    return queries.select("query_id", "query").join(vx.mean_vectors(vectors, "query_id", "vector"), "query_id", "left")


def hyde_search(chunks: DataFrame, queries: DataFrame, k: int, hyde: DataFrame, where: Column | None = None, respects_filter: bool = False, find: Callable[..., DataFrame] | None = None, **options: object) -> DataFrame:
    """Search with the vectors of `hyde` and the queries' own words. Filters apply only if `respects_filter`.

    A query without a hypothetical vector falls back to its own. `find`(queries, k, where, **options) stands for the search
    of `chunks`.
    """
    asked = queries.join(hyde.select("query_id", F.col("vector").alias("_v")), "query_id", "left").withColumn("vector", F.coalesce("_v", "vector")).drop("_v")
    where = where if respects_filter else None
    return find(asked, k, where, **options) if find else search(chunks, asked, k, where, **options)


def adaptive_hyde_search(chunks: DataFrame, queries: DataFrame, k: int, hyde: DataFrame, threshold: float = 0.5, where: Column | None = None, find: Callable[..., DataFrame] | None = None, **options: object) -> DataFrame:
    """Plain search; queries whose best score is under the threshold are searched again with hypothetical vectors.

    A query without plain hits is not searched again, and one without a hypothetical vector, as after a failure, keeps its
    plain hits. Fused scores stay under 2 / 61, so that on the usual threshold every query with hits is searched again.
    """
    # A few rows a query, read several times.
    plain = durable((find(queries, k, where, **options) if find else search(chunks, queries, k, where, **options)).select(*HITS))
    weak = plain.where((F.col("rank") == 1) & (F.col("score") < threshold)).select("query_id")
    weak = durable(weak.join(hyde.where(F.col("vector").isNotNull()).select("query_id"), "query_id", "left_semi"))
    again = hyde_search(chunks, queries.join(small(weak), "query_id", "left_semi"), k, hyde, find=find, **options)
    return plain.join(small(weak), "query_id", "left_anti").select(*HITS).unionByName(again.select(*HITS))


def cache_lookup(cache: DataFrame, queries: DataFrame, now: Column, threshold: float = 0.9, ttl_seconds: int = 0) -> DataFrame:
    """query_id, cache_id, score for queries whose nearest cached query is similar enough and not expired.

    The nearest entry alone is judged: if it is expired, a fresh second one is not looked at. Entries without a time do
    not expire, and ttl 0 lets none expire.
    """
    nearest = dense_topk(cache.withColumnRenamed("id", "chunk_id"), queries, 1, digits=6)
    hit = nearest.where(F.col("score") >= threshold).join(cache.select(F.col("id").alias("chunk_id"), "cached_at"), "chunk_id")
    if ttl_seconds > 0:
        age = F.unix_timestamp(now) - F.unix_timestamp("cached_at")
        hit = hit.where(F.coalesce(age <= ttl_seconds, F.lit(True)))
    return hit.select("query_id", F.col("chunk_id").alias("cache_id"), "score")


def cache_or_search(cache: DataFrame, queries: DataFrame, k: int, find, now: Column, threshold: float = 0.9, ttl_seconds: int = 0) -> DataFrame:
    """query_id, rank, chunk_id, from_cache: the first k cached results where the cache knows the query; else `find`(queries).

    cache: id, vector, results array<string> (chunk ids by rank), cached_at.
    """
    hits = cache_lookup(cache, queries, now, threshold, ttl_seconds)
    known = hits.join(cache.select(F.col("id").alias("cache_id"), "results"), "cache_id").select("query_id", F.posexplode("results").alias("_p", "chunk_id")).where(F.col("_p") < k)
    found = find(queries.join(small(hits.select("query_id")), "query_id", "left_anti"))
    return known.select("query_id", (F.col("_p") + 1).alias("rank"), "chunk_id", F.lit(True).alias("from_cache")).unionByName(found.select("query_id", "rank", "chunk_id", F.lit(False).alias("from_cache")))


def cache_entries(queries: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Cache rows (id, query, vector, results, cached_at) of answered queries."""
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("results"))
    return queries.join(listed, "query_id").select(tx.uuid5(tx.CACHE_NAMESPACE, F.col("query")).alias("id"), "query", "vector", "results", F.date_trunc("second", now).alias("cached_at"))


#: Cache rows that hold whole result lists, for an `Index` with by="id".
RESULT_CACHE = "id string, query string, vector array<float>, results array<struct<rank:int,file_path:string,header:string,line_start:int,score:float,text:string>>, cached_at timestamp"
RESULT_FIELDS = ["rank", "file_path", "header", "line_start", "score", "text"]


def result_entries(queries: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Rows of RESULT_CACHE for queries (query_id, query, vector) with results; those without leave no row."""
    row = F.struct(F.col("rank").cast("int").alias("rank"), *RESULT_FIELDS[1:])
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    return queries.join(listed, "query_id").select(tx.uuid5(tx.CACHE_NAMESPACE, F.col("query")).alias("id"), "query", "vector", "results", F.date_trunc("second", now).alias("cached_at"))
