"""The tables that operators take and return.

points   (id long, features array<double>)
queries  (query_id long, features array<double>)
edges    (src long, nbr long, distance double)        a directed, weighted graph
results  (query_id long, rank int, nbr long, distance double)
truth    (query_id long, nbr long)
assign   (id long, features array<double>, cells array<int>, cell int)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_points(df: DataFrame, id_col: str, features_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features_col).cast("array<double>").alias("features"))


def as_queries(df: DataFrame, id_col: str, features_col: str) -> DataFrame:
    return as_points(df, id_col, features_col).withColumnRenamed("id", "query_id")


def require_k(k: int, most: int | None = None) -> None:
    if k < 1 or (most is not None and k > most):
        raise ValueError(f"k must be from 1 to {'n - 1, here ' + str(most) if most is not None else 'any number'}: {k}")
