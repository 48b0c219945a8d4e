"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm.common import bucket_hash, durable, small

HASH_BITS, LEVEL_BITS = 60, 12
#: Sources that one task numbers, on average.
SOURCE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, counted as the places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """`sizes` with `_i`, the number of each source from 0 by code point, null last.

    Sources are dealt into ranges and numbered there, shifted by the rows of the ranges before: no task sorts them all.
    """
    order = F.col("source").asc_nulls_last()
    # Written, as ranges follow from a sample that another run of the stage need not repeat.
    dealt = durable(sizes.repartitionByRange(sizes.count() // SOURCE_ROWS + 1, order).withColumn("_part", F.spark_partition_id()))
    # One row for each range.
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.join(small(before), "_part").withColumn("_i", F.col("_before") + place).drop("_part", "_before")


def source_targets(sizes: DataFrame, weights: list[int], share: tuple[int, int], most: int) -> DataFrame:
    """Targets of the sources of `sizes` (source, source_size).

    Sources by code point, null last, weigh as `weights` repeating, and share share[0]/share[1] of all sizes. A target
    stops at `most` times its source's size and the excess is reshared by weight, until none is above: a source is
    capped if its cap is under weight * level. Each round sums the caps under the level and the weights left, which
    gives the next level; it only rises, and ends as no further source is capped.
    """
    num, den = share
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights)).cast("int") + 1).cast("long")
    weighed = durable(numbered_sources(sizes).select("source", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap")))
    size, left = weighed.agg(F.sum("source_size"), F.sum("_w")).first()
    if left is None:
        return weighed.select("source", "source_size", F.lit(None).cast("double").alias("target"))
    budget = size * num / den
    level, caps, known = budget / left, 0, -1
    while True:
        under = F.col("_cap") / F.col("_w") < level
        n, capped, open_ = weighed.agg(F.count_if(under), F.coalesce(F.sum(F.when(under, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~under, F.col("_w"))), F.lit(0))).first()
        if n == known:
            break
        known, caps, left = n, capped, open_
        if not left:
            break
        level = max(level, (budget - caps) / left)
    target = F.when(under, F.col("_cap").cast("double"))
    if left:
        target = target.otherwise(F.col("_w") * F.lit(float(budget - caps)) / F.lit(left))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, weights: list[int], share: tuple[int, int], most: int = 2, key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: how often each row enters the mix.

    A source whose target is t times its size takes every row floor(t) times, and once more the rows whose key hash is
    under the source's threshold. The threshold is found without sorting rows: sizes are summed by source and the first
    bits of the hash, a window over these few sums finds the last bucket that fits into the budget, and only rows of the
    boundary bucket are summed again by the next bits, until the hash is used up. Thresholds are nested: a larger budget
    takes every row that a smaller one takes.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own; a null key hashes like an empty
    one. Rows with the same key share a hash and are taken together or not at all, so that a source misses its target
    by less than the rows of one key. An empty table gives no rows.
    """
    base = durable(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), bucket_hash(F.col(key)).alias("_h")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = durable(source_targets(sizes, weights, share, most).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")))
    state = goals.select(F.col("source").alias("_s"), "_left", F.lit(0).cast("long").alias("_prefix"))
    done = 0
    while done < HASH_BITS:
        bits = min(LEVEL_BITS, HASH_BITS - done)
        low = HASH_BITS - done - bits
        inside = base.join(small(state), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", HASH_BITS - done) == F.col("_prefix")))
        sums = inside.groupBy("_s", "_prefix", "_left", F.shiftright("_h", low).alias("_bucket")).agg(F.sum("size").alias("_n"))
        upto = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        walked = sums.withColumn("_cum", F.sum("_n").over(upto))
        over = F.col("_cum") > F.col("_left")
        found = walked.groupBy("_s", "_left").agg(F.min(F.when(over, F.col("_bucket"))).alias("_edge"), F.max(F.when(~over, F.col("_cum"))).alias("_fit"))
        # Without an edge everything of the bucket fits: the threshold lies behind its last hash.
        state = durable(found.where(F.col("_edge").isNotNull()).select("_s", (F.col("_left") - F.coalesce("_fit", F.lit(0))).alias("_left"), F.col("_edge").alias("_prefix")))
        done += bits
    edges = state.select("_s", F.col("_prefix").alias("_threshold"))
    taken = (
        base.join(small(goals.drop("_s").withColumnRenamed("source", "_g")), F.col("source").eqNullSafe(F.col("_g")))
        .join(small(edges), F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("copies", (F.col("_whole") + F.when(F.col("_left") > 0, F.col("_threshold").isNull() | (F.col("_h") < F.col("_threshold"))).otherwise(False).cast("int")).cast("long"))
    )
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
