"""Similarity of embeddings with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length one; a null vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_pair_similarity(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean cosine of all pairs in a group, without making them: the squared length of the sum of unit vectors holds
    every pair twice and every vector with itself once. Sums go by group and dimension, in one shuffle."""
    u = rows.select(by, F.posexplode(unit(F.col(vector))).alias("d", "x"))
    sums = u.groupBy(by, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("m"))
    got = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"), F.max("m").alias("n"))
    return got.select(by, F.col("n"), F.coalesce(F.try_divide(F.col("all") - F.col("own"), (F.col("n") * (F.col("n") - 1)).cast("double")), F.lit(0.0)).alias("mean_similarity"))
