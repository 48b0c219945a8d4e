"""Pluggable models: batch functions with deterministic stand-ins that need no service.

A model is any object with the method of its protocol. It is called inside tasks with whole Arrow batches; retries and
time limits belong to the implementation or to `with_retries`. The stand-ins check the plumbing, not retrieval quality.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftmill.functions import text as tx

#: Prompts for hypothetical passages; the first is the default, all five take turns.
HYDE_PROMPTS = [
    "Write a short, factual passage (2-4 sentences) that directly answers this question. Be specific and informative.\n\nQuestion: %s\n\nPassage:",
    "List the key facts and concepts that would appear in a document answering this question. Be concise and precise.\n\nQuestion: %s\n\nFacts:",
    "Write a brief expert explanation (2-3 sentences) of the topic in this question, as it would appear in technical documentation.\n\nQuestion: %s\n\nExplanation:",
    "Provide a concise definition and context for the main concept in this question, as found in a reference document.\n\nQuestion: %s\n\nDefinition:",
    "Describe a concrete example or use-case that illustrates the answer to this question, in 2-3 sentences.\n\nQuestion: %s\n\nExample:",
]


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SparseEmbedder(Protocol):
    def embed(self, texts: list[str], kind: str) -> list[tuple[list[int], list[float]]]: ...


class Reranker(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


class TextGenerator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class RelevanceScorer(Protocol):
    """Rates hits: a column over query and text, null where nothing is known."""

    def column(self, query: Column, text: Column) -> Column: ...


class Chunker(Protocol):
    """Chunks of (file_path, text, ...) as `markdown.chunk_documents` makes them."""

    def chunks(self, docs: DataFrame) -> DataFrame: ...


class Lister(Protocol):
    """Files with path, root, sha and content, as `files.list_markdown` lists them."""

    def files(self) -> DataFrame: ...


class ChunkStore(Protocol):
    """What ingest and search ask of an index; `sources.index.Index` is one."""

    def read(self) -> DataFrame: ...

    def file_shas(self) -> DataFrame: ...

    def change(self, new: DataFrame | None = None, gone: DataFrame | None = None) -> object: ...


class ModelError(RuntimeError):
    """A model failed, or answered with another number of results than it was asked for."""


class HashEmbedder:
    """Signed feature hashing of words."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h & 0x80000000 else -1.0
            out.append(v)
        return out


class HashSparseEmbedder:
    """Term counts under the checksums of the terms."""

    def embed(self, texts: list[str], kind: str) -> list[tuple[list[int], list[float]]]:
        out = []
        for t in texts:
            counts: dict[int, float] = {}
            for w in t.lower().split():
                counts[zlib.crc32(w.encode())] = counts.get(zlib.crc32(w.encode()), 0.0) + 1.0
            out.append((sorted(counts), [counts[k] for k in sorted(counts)]))
        return out


class RelativeReranker:
    """A passage's length as a share of all that are scored with it: shows whether a query's passages come together."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        total = sum(map(len, passages)) or 1
        return [len(p) / total for p in passages]


class EchoGenerator:
    """Answers with the prompt's question."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.partition("Question: ")[2].partition("\n")[0] or p for p in prompts]


class LengthEmbedder:
    """The text's length as its vector; fails on a batch that has a text with the mark at its start."""

    def __init__(self, mark: str = "", dimension: int = 1):
        self.mark, self.dimension = mark, dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.mark and any(t.startswith(self.mark) for t in texts):
            raise ModelError(f"a text starts with {self.mark}")
        return [[float(len(t))] * self.dimension for t in texts]


class CyclicEmbedder:
    """Vectors that follow from the number of a text's characters alone."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t) * (k + 1) * 7919 % 101 - 50) for k in range(self.dimension)] for t in texts]


class AlternatingJudge:
    """Likes the first passage of a prompt, the third and so on; fails on batches that have a prompt with the mark."""

    def __init__(self, mark: str = ""):
        self.mark = mark

    def generate(self, prompts: list[str]) -> list[str]:
        if self.mark and any(self.mark in p for p in prompts):
            raise ModelError("a prompt has the mark")
        counts = [len(re.findall(r"^\[\d+\] ", p.partition("Passages:\n")[2], re.M)) for p in prompts]
        return [json.dumps([0.9 - 0.8 * (i % 2) for i in range(n)]) for n in counts]


def with_retries(call: Callable, attempts: int = 3, wait: float = 0.5, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """`call`, tried again up to `attempts` times after failures, with growing pauses."""

    def tried(*args: object) -> object:
        pause = wait
        for k in range(attempts + 1):
            try:
                return call(*args)
            except Exception:
                if k == attempts:
                    raise
                sleep(pause)
                pause *= factor
        return None

    return tried


def embed_column(embedder: Embedder, text: Column, attempts: int = 3, wait: float = 0.5, isolate: bool = False) -> Column:
    """Vectors of a text column, batch by batch.

    With `isolate`, the texts of a batch that fails are tried one by one, and those that fail get a null vector.
    """

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = with_retries(embedder.embed, attempts, wait)

        def vectors_of(texts: list[str], call: Callable = call) -> list:
            found = call(texts)
            if len(found) != len(texts):
                raise ModelError(f"{len(texts)} texts gave {len(found)} vectors")
            return list(found)

        def one(text: str) -> list[float] | None:
            try:
                return vectors_of([text], embedder.embed)[0]  # the pauses are behind us
            except Exception:
                return None

        for texts in batches:
            plain = texts.fillna("").tolist()
            try:
                vectors = vectors_of(plain)
            except Exception:
                if not isolate:
                    raise
                vectors = [one(t) for t in plain]
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return embedded(text)


def sparse_column(embedder: SparseEmbedder, text: Column, kind: str) -> Column:
    """Structs (indices, values) of a text column; `kind` is query or passage."""

    @F.pandas_udf("indices array<long>, values array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = embedder.embed(texts.fillna("").tolist(), kind)
            if len(found) != len(texts):
                raise ModelError(f"{len(texts)} texts gave {len(found)} vectors")
            yield pd.DataFrame({"indices": [list(i) for i, _ in found], "values": [list(v) for _, v in found]}, index=texts.index)

    return embedded(text)


def generate_column(generator: TextGenerator, prompt: Column) -> Column:
    """Generated texts; a null where the generator failed or gave nothing. Prompts of a failing batch are tried one by one."""

    @F.pandas_udf("string")
    def generated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt: str) -> str | None:
            try:
                return generator.generate([prompt])[0]
            except Exception:
                return None

        for prompts in batches:
            plain = prompts.fillna("").tolist()
            try:
                texts = generator.generate(plain)
            except Exception:
                texts = [one(p) for p in plain]
            if len(texts) != len(prompts):
                raise ModelError(f"{len(prompts)} prompts gave {len(texts)} texts")
            yield pd.Series([t or None for t in texts], index=prompts.index, dtype=object)

    return generated(prompt)


def rerank_column(reranker: Reranker, query: Column, passage: Column) -> Column:
    """Scores of (query, passage) rows; passages of one query in a batch are scored together."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in batches:
            out = pd.Series(0.0, index=queries.index)
            for q, at in queries.groupby(queries, dropna=False).groups.items():
                scores = reranker.score("" if pd.isna(q) else q, passages.loc[at].fillna("").tolist())
                if len(scores) != len(at):
                    raise ModelError(f"{len(at)} passages gave {len(scores)} scores")
                out.loc[at] = scores
            yield out

    return scored(query, passage)


def rerank_groups(hits: DataFrame, reranker: Reranker, key: str = "query_id", query: str = "query", passage: str = "text", to: str = "score") -> DataFrame:
    """The hits with the reranker's scores in column `to`, all passages of a query in one call, in the order of `rank` if there is one.

    A query's passages come in Arrow batches of any size and are gathered before the call: what is held at once is the hits
    of one query. Null texts count as empty. A number of scores that does not fit is an error.
    """
    columns = [c for c in hits.columns if c != to]
    schema = StructType([hits.schema[c] for c in columns]).add(to, "double")
    ordered = "rank" in columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if ordered:
            table = table.sort_by("rank")
        asked = table.column(query)[0].as_py() or ""
        scores = reranker.score(asked, [t or "" for t in table.column(passage).to_pylist()])
        if len(scores) != len(table):
            raise ModelError(f"{len(table)} passages gave {len(scores)} scores")
        yield from table.append_column(to, pa.array([float(x) for x in scores], pa.float64())).to_batches()

    scored.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # Spark reads them
    return hits.select(*columns).groupBy(key).applyInArrow(scored, schema)


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the query's distinct words that the passage has: the stand-in of rerankers and relevance filters."""
    q = F.array_distinct(tx.word_tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tx.word_tokens(passage))) / F.size(q))


def hyde_prompts(queries: DataFrame, n: int, several: bool = False, query: str = "query") -> DataFrame:
    """Each query n times with doc_no 0 .. n-1 and its prompt; with `several`, the five prompts take turns."""
    prompts = F.array(*map(F.lit, HYDE_PROMPTS if several else HYDE_PROMPTS[:1]))
    numbered = queries.withColumn("doc_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    template = F.element_at(prompts, (F.col("doc_no") % F.size(prompts) + 1).cast("int"))
    return numbered.withColumn("prompt", F.replace(template, F.lit("%s"), F.col(query)))
