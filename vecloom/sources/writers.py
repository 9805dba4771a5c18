"""Graphs and results as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lists(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance", "nbr"))).alias("near"))


def index_lines(edges: DataFrame, decimals: int | None = None) -> DataFrame:
    """(src, line, value): for each source the line of its id and neighbours, then 0.0 and their distances, between tabs.

    With `decimals` distances have so many places.
    """
    near = _lists(edges, "src")
    text = lambda x: x.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", x)
    join = lambda head, field: F.concat_ws("\t", head, F.transform("near", lambda x: x["nbr"].cast("string") if field == "nbr" else text(x["distance"])))
    return near.select("src", F.posexplode(F.array(join(F.col("src").cast("string"), "nbr"), join(F.lit("0.0"), "distance"))).alias("line", "value"))


def dump_index(edges: DataFrame, path: str, files: int | None = None) -> None:
    """Writes the graph's lines, a source's two together, sources in order inside a file; as many files as given, or as Spark has partitions."""
    lines = index_lines(edges)
    lines = lines.repartition(files, "src") if files else lines.repartition("src")
    lines.sortWithinPartitions("src", "line").select("value").write.text(path)


def result_lines(results: DataFrame, field: str) -> DataFrame:
    """(query_id, value): one line a query, each value with a tab after it."""
    near = _lists(results, "query_id")
    return near.select("query_id", F.concat(F.array_join(F.transform("near", lambda x: x[field].cast("string")), "\t"), F.lit("\t")).alias("value"))


def dump_results(results: DataFrame, path: str, files: int | None = None) -> None:
    """Writes <path>-neighbors and <path>-distances, folders of part files: in their names' order, line i is the i-th query.

    Ranges of queries are written by as many tasks as Spark has partitions, or as `files` says; with files=1 each folder has one file.
    """
    for name, field in (("neighbors", "nbr"), ("distances", "distance")):
        lines = result_lines(results, field)
        lines = lines.repartitionByRange(files, "query_id") if files else lines.repartitionByRange("query_id")
        lines.sortWithinPartitions("query_id").select("value").write.text(f"{path}-{name}")
