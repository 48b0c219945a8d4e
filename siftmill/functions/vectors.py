"""Vector expressions over array<float> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """Unit vector as floats; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def sparse_dot(q_indices: Column, q_values: Column, d_indices: Column, d_values: Column) -> Column:
    """Sum of products over shared indices; of a repeated document index the last value counts."""
    pairs = F.arrays_zip(q_indices.alias("i"), q_values.alias("v"))

    def value(index: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(d_indices)), lambda k: F.element_at(d_indices, k) == index)
        return F.when(F.size(d_indices) > 0, F.try_element_at(d_values, F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(10**9))))

    return _sum(F.transform(pairs, lambda p: F.coalesce(p["v"].cast("double") * value(p["i"]).cast("double"), F.lit(0.0))))


def mean_vectors(df: DataFrame, group: str, vector: str, to: str = "vector", unit: bool = True) -> DataFrame:
    """The mean of each group's vectors, by place, with partial sums on the map side; normalised if `unit`."""
    places = df.select(group, F.posexplode(vector).alias("place", "x"))
    means = places.groupBy(group, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(to))
    return listed.withColumn(to, l2_normalize(F.col(to)) if unit else F.transform(to, lambda x: x.cast("float")))
