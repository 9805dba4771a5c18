"""How good results are against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two lists of ids."""
    return F.size(F.array_intersect(a, b))


def _hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    true = truth.select("query_id", "nbr").distinct().withColumn("hit", F.lit(1))
    return results.select("query_id", "nbr").join(true, ["query_id", "nbr"], "left").groupBy("query_id").agg(F.count("*").alias("found"), F.count("hit").alias("hits"))


def accuracy(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: least, mean and greatest percentage of a query's results that are true; queries without results don't count."""
    percent = F.lit(100.0) * F.col("hits") / F.col("found")
    return _hits(results, truth).agg(F.min(percent).alias("min_accuracy"), F.avg(percent).alias("mean_accuracy"), F.max(percent).alias("max_accuracy"))


def recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true results of all queries by results of all queries; null without any."""
    return _hits(results, truth).agg((F.sum("hits") / F.sum("found")).alias("recall"))
