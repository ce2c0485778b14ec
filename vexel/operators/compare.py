"""Comparison of two searches: overlap, recall, work saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """(query_id, jaccard): shared over all distinct ids of each query in both results. A query in neither has no row; see jaccard()."""
    mark = lambda df, name: df.select("query_id", "global_id").distinct().withColumn(name, F.lit(1))
    both = mark(one, "a").join(mark(two, "b"), ["query_id", "global_id"], "full")
    return both.groupBy("query_id").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("jaccard"))


def jaccard(a: F.Column, b: F.Column) -> F.Column:
    """Of two id arrays; 1.0 when both are empty."""
    size = F.size(F.array_union(a, b))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / size)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the true hits that were found."""
    hit = found.select("query_id", "global_id").distinct().withColumn("hit", F.lit(1))
    return truth.join(hit, ["query_id", "global_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def visit_reduction(standard: F.Column, other: F.Column) -> F.Column:
    """1 - other / standard; 0.0 where standard is 0."""
    return F.when(standard == 0, F.lit(0.0)).otherwise(1 - other / standard)
