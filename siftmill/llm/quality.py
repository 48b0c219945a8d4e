"""Quality classifier: importance resampling with hashed n-gram models of target and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import bucket_hash, durable
from siftmill.llm.kernels import LOWER, chunks, mix64, prefix_hash, span_hash, text_column

#: Hash buckets of words and pairs of neighbouring words together.
BUCKETS = 1 << 18
#: Labelled target rows that the target model is fitted on at most: those of the smallest key hashes.
TARGET_ROWS = 50_000
#: Pseudo-count of each bucket of the target model, given in the proportions of the raw model.
PSEUDO = 10.0
#: n-grams that every text counts for: weights are log likelihood ratios of so many n-grams with the text's frequencies.
LENGTH = 200.0

# A word is a run of letters, digits, underscores and bytes outside ASCII, or a run of other signs; whitespace parts words.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the hashed n-grams of each document: A-Z-folded words and pairs of neighbouring words."""
    folded, kind = LOWER[data], _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[starts] = True
    at = np.flatnonzero(edge)
    inside = kind[at[:-1]] > 0
    start, end = at[:-1][inside], at[1:][inside]
    doc = np.searchsorted(starts, start, "right") - 1
    word = span_hash(prefix_hash(folded), start, end)
    pair = mix64(word[:-1] * np.uint64(3) + word[1:] * np.uint64(5))[doc[1:] == doc[:-1]]
    bucket = np.concatenate([word, pair]) % np.uint64(BUCKETS)
    owner = np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]])
    both, n = np.unique(owner * BUCKETS + bucket.astype(np.int64), return_counts=True)
    return both // BUCKETS, both % BUCKETS, n


def count_features(docs: DataFrame, target: np.ndarray, key: str, text: str) -> DataFrame:
    """bucket, raw, target: n-grams of all rows, and of the rows whose key is in the sorted array `target`."""
    ids = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            data, offsets = text_column(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            member = known & np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), ids.value)
            for lo, hi, part, starts in chunks(data, offsets, 1 << 18):
                doc, bucket, n = features(part, starts)
                raw += np.bincount(bucket, n, BUCKETS)
                hit += np.bincount(bucket, n * member[lo:hi][doc], BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at].astype(np.int64)), pa.array(hit[at].astype(np.int64))], names=["bucket", "raw", "target"])

    parts = docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each of the BUCKETS, the only thing that goes through the driver.

    The target model is smoothed with PSEUDO counts in the proportions of the raw one, so that a rare bucket that the
    labelled rows happen to lack says little; no ratio is cut off.
    """
    found = counts.toArrow()
    raw, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found.column("bucket").to_numpy()
    raw[at], hit[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    if not raw.sum() or not hit.sum():
        return np.zeros(BUCKETS)
    return np.log((hit + PSEUDO) / (raw * (hit.sum() / raw.sum()) + PSEUDO))


def log_weight(ratios: np.ndarray, spark_context) -> callable:
    """An Arrow function of text: LENGTH times the mean log ratio of its n-grams; 0 without any."""
    shared = spark_context.broadcast(ratios)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = text_column(column)
            out = np.zeros(len(offsets) - 1)
            for lo, hi, part, starts in chunks(data, offsets, 1 << 18):
                doc, bucket, n = features(part, starts)
                total = np.bincount(doc, n, hi - lo)
                out[lo:hi] = LENGTH * np.bincount(doc, n * shared.value[bucket], hi - lo) / np.maximum(total, 1)
            yield pa.array(out)

    return F.arrow_udf(score, "double")


def kth_largest(df: DataFrame, value: str, k: int, bits: int = 64, step: int = 12) -> int | None:
    """The k-th largest of a column of longs under 2**bits, by histograms of nested ranges of at most 2**step counts."""
    if k < 1:
        return None
    prefix, done = 0, 0
    while done < bits:
        now = min(step, bits - done)
        low = bits - done - now
        inside = df.where(F.shiftright(value, bits - done) == prefix) if done else df
        counts = sorted(((r[0], r[1]) for r in inside.groupBy(F.shiftright(value, low).alias("b")).count().collect()), reverse=True)
        for b, n in counts:
            if n >= k:
                prefix = b
                break
            k -= n
        else:
            return None
        done += now
    return prefix


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    u = (bucket_hash(F.concat_ws("/", F.lit(seed), key.cast("string"))) + F.lit(0.5)) / F.lit(float(1 << 60))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, is_target: Column, key: str = "doc_id", text: str = "text", target_rows: int = TARGET_ROWS, seed: int = 7, k: int | None = None) -> DataFrame:
    """The keys of the k rows with the largest log weight + Gumbel noise: a sample without replacement that follows the target.

    log weight: log(p_target / p_raw) of a text under two models of hashed n-grams (words and pairs of neighbouring words,
    each as often as it occurs), scaled to LENGTH n-grams: plain sums would rank texts by their length. The raw model
    counts all rows, the target model those labelled as target (at most `target_rows`, those with the smallest key hashes).
    Without `k`, k is the expected number of target rows: the share of targets among the labelled rows, times all rows.

    Returns key, log_weight and gumbel_key of the rows taken; rows that tie with the k-th on all 48 bits of the rounded key
    are all taken. A null, empty or blank text has no evidence (log weight 0); a very long one is read whole. Rows that share
    a key share their noise and are weighed one by one. A null key takes part, with the noise of an empty one. Without
    labelled targets no row is taken. An empty table gives no rows. Other columns of either table are not read.
    """
    marked = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(is_target.cast("int")).alias("_t"))
    n_labelled, n_target = marked.agg(F.count("*"), F.coalesce(F.sum("_t"), F.lit(0))).first()
    # TakeOrdered of a bounded number of rows: each task keeps `target_rows` at most.
    chosen = [r[0] for r in marked.where("_t = 1").orderBy(bucket_hash(F.col(key)), key).limit(target_rows).collect()]
    ratios = log_ratios(count_features(docs, np.array(sorted(chosen), np.int64), key, text))
    weigh = log_weight(ratios, docs.sparkSession.sparkContext)
    scored = docs.select(F.col(key), weigh(F.col(text).cast("binary")).alias("log_weight"))
    scored = durable(
        scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.coalesce(F.col(key).cast("string"), F.lit("")), seed))
        # The key in steps of 2**-20, moved above zero: longs of 48 bits.
        .withColumn("_rank", F.least(F.greatest(F.round(F.col("gumbel_key") * (1 << 20)).cast("long") + (1 << 47), F.lit(0)), F.lit((1 << 48) - 1)))
    )
    if k is None:
        k = -(-scored.count() * n_target // n_labelled) if n_labelled else 0
    edge = kth_largest(scored, "_rank", k, bits=48)
    kept = scored.where(F.col("_rank") >= edge) if edge is not None else scored.where(F.lit(k >= 1))
    return kept.select(key, "log_weight", "gumbel_key")
