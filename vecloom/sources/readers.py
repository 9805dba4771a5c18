"""Points, queries and truth from text files and wide tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

#: A number at the start of a token.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number(token: Column, kind: str = "double") -> Column:
    """The number that the token starts with; null if it starts with none."""
    return F.regexp_extract(token, NUMBER, 0).try_cast("double").try_cast(kind)


def _values(tokens: Column, kind: str) -> Column:
    """The tokens' numbers up to the first token that isn't all number, of which a number at its start still counts."""
    whole = F.transform(tokens, lambda t: F.rlike(t, F.lit(NUMBER + "$")))
    end = F.coalesce(F.nullif(F.array_position(whole, False), F.lit(0)), F.size(tokens).cast("long"))
    return F.filter(F.transform(F.slice(tokens, F.lit(1), F.greatest(end, F.lit(0)).cast("int")), lambda t: number(t, kind)), lambda v: v.isNotNull())


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def _plain(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def _given(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[int]]:
    """The places in the list of each path that it names, as file systems write them; what a pattern matches has the pattern's place."""
    conf, places = spark._jsc.hadoopConfiguration(), {}
    for i, path in enumerate(paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = [s.getPath() for s in fs.globStatus(p) or []] if re.search(r"[*?\[{]", path) else [fs.makeQualified(p)]
        if not found:
            raise ValueError(f"{path} matches no file")
        for one in found:
            places.setdefault(_plain(one.toString()), []).append(i)
    return places


def _above(path: str) -> list[str]:
    """The folders that the path is in."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)]


#: Blocks of files up to which their first numbers are broadcast, at some 100 bytes each.
BROADCAST_BLOCKS = 1_000_000


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(line_number, value) of all lines of the files in the given order, numbered from 0; those of a folder in their names' order.

    All files are one scan, whatever their number. A first pass counts the lines of each block of a file that a task reads and notes the scan's
    number of its first; then a line's number is its block's begin and its distance from that first line. So text is neither shuffled nor
    sorted, and what is gathered is a row a block. A file that is given twice is read once and numbered twice.
    """
    if not paths:
        return spark.createDataFrame([], "line_number long, value string")
    meta, places = F.col("_metadata"), _given(spark, paths)
    roots = sorted(p for p in places if not any(above in places for above in _above(p)))  # a file in a given folder is read with it
    lines = spark.read.text(roots).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    order = []
    for r in blocks:
        file = _plain(unquote(r["file"]))
        order += [(i, r["file"], r["block"], r["n"], r["first"]) for one in (file, *_above(file)) for i in places.get(one, [])]
    begins, begin = [], 0
    for _, file, block, n, first in sorted(order):
        begins.append((file, block, begin - first))
        begin += n
    shifts = spark.createDataFrame(begins, "file string, block long, shift long")
    return lines.join(F.broadcast(shifts) if len(begins) <= BROADCAST_BLOCKS else shifts, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("line_number"), "value")


def read_wsv(spark: SparkSession, paths: Sequence[str], kind: str = "double") -> DataFrame:
    """points, one a line of numbers between white space; the id is the line's number. A blank line has an empty vector."""
    return numbered_lines(spark, paths).select(F.col("line_number").alias("id"), _values(_tokens(F.col("value")), kind).alias("features"))


def read_with(spark: SparkSession, paths: Sequence[str], convert: Callable[[Column], tuple[Column, Column]], check: bool = True) -> DataFrame:
    """points by a user's converter from a line to id and features; ValueError for invalid lines and repeated ids."""
    key, features = convert(F.col("value"))
    points = spark.read.text(list(paths)).select("value", key.alias("id"), features.alias("features"))
    if check:
        bad = points.where(F.col("id").isNull() | F.col("features").isNull() | (F.size("features") == 0)).limit(1).collect()
        if bad:
            raise ValueError(f"invalid line: {bad[0]['value']!r}")
        twice = points.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"id {twice[0]['id']} is there {twice[0]['count']} times")
    return points.select("id", "features")


def line_converter(convert: Callable[[str], tuple[int, Sequence[float]] | None]) -> UserDefinedTableFunction:
    """A table function from a line to (id, features, problem), for lateral joins with any table that has lines, by a user's Python function.

    The function gives an id and a vector. A line for which it gives None, an empty vector or no id, or raises, has a row without
    these that says why; a null line counts as such a one.
    """

    class Converter:
        def eval(self, line: str):
            try:
                made = None if line is None else convert(line)
                if made is None or made[0] is None or made[1] is None or not len(made[1]):
                    yield None, None, "no id or no features"
                else:
                    yield int(made[0]), [float(x) for x in made[1]], None
            except Exception as error:
                yield None, None, f"{type(error).__name__}: {error}"

    return F.udtf(Converter, returnType="id long, features array<double>, problem string")


def read_converted(spark: SparkSession, paths: Sequence[str], convert: Callable[[str], tuple[int, Sequence[float]] | None], bad: str = "error") -> DataFrame:
    """points by a user's Python function from a line to id and features; ValueError for repeated ids.

    What happens to lines that it doesn't convert: "error", the default, raises ValueError with one of them, "rows" keeps them as
    rows of value and problem beside id and features, "drop" leaves them out.
    """
    if bad not in ("error", "rows", "drop"):
        raise ValueError(f"bad lines are an error, rows or dropped: {bad!r}")
    lines = spark.read.text(list(paths))
    made = lines.lateralJoin(line_converter(convert)(F.col("value").outer()))
    if bad == "error":
        wrong = made.where("problem IS NOT NULL").limit(1).collect()
        if wrong:
            raise ValueError(f"invalid line: {wrong[0]['value']!r}, {wrong[0]['problem']}")
    twice = made.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0]['id']} is there {twice[0]['count']} times")
    return made.select("id", "features", "value", "problem") if bad == "rows" else made.where("problem IS NULL").select("id", "features")


def read_wsv_id(spark: SparkSession, paths: Sequence[str], kind: str = "double") -> DataFrame:
    def convert(line: Column) -> tuple[Column, Column]:
        tokens = _tokens(line)
        return number(F.get(tokens, F.lit(0)), "long"), F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: number(t, kind))

    return read_with(spark, paths, convert)


def read_delimited_id(spark: SparkSession, paths: Sequence[str], delimiter: str = ",", kind: str = "double") -> DataFrame:
    def convert(line: Column) -> tuple[Column, Column]:
        tokens = F.transform(F.split(line, "\\Q" + delimiter + "\\E"), lambda t: F.trim(t))
        return number(F.get(tokens, F.lit(0)), "long"), F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: number(t, kind))

    return read_with(spark, paths, convert)


def read_named_tsv(spark: SparkSession, paths: Sequence[str], dimensions: int) -> DataFrame:
    """points of lines index, name, values between tabs: at most `dimensions` values, bad ones left out; the name isn't kept."""
    tokens = F.split("value", "\t")
    values = F.filter(F.transform(F.slice(tokens, F.lit(3), F.lit(dimensions)), lambda t: number(t)), lambda v: v.isNotNull())
    return spark.read.text(list(paths)).select(number(F.get(tokens, F.lit(0)), "long").alias("id"), values.alias("features"))


def vector_columns(df: DataFrame, index: str = "index") -> list[str]:
    """All columns but the index, by name, numbers in names by size."""
    return sorted((c for c in df.columns if c != index), key=lambda c: [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", c)])


def from_wide(tables: DataFrame | Sequence[DataFrame], index: str = "index") -> DataFrame:
    """points of tables with an index column and one column a feature, in the names' order; ValueError if tables differ in columns."""
    tables = [tables] if isinstance(tables, DataFrame) else list(tables)
    names = {tuple(vector_columns(t, index)) for t in tables}
    if len({len(n) for n in names}) > 1:
        raise ValueError(f"tables have from {min(map(len, names))} to {max(map(len, names))} features")
    out = None
    for t in tables:
        one = t.select(F.col(index).cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in vector_columns(t, index))).alias("features"))
        out = one if out is None else out.unionByName(one)
    return out


def truth_from_wide(df: DataFrame, k: int, index: str = "index") -> DataFrame:
    """truth of a table with an index column and one column a neighbour: the first k; ValueError if there are fewer."""
    columns = vector_columns(df, index)
    if len(columns) < k:
        raise ValueError(f"the truth has {len(columns)} neighbours a query, fewer than {k}")
    return df.select(F.col(index).cast("long").alias("query_id"), F.explode(F.array(*(F.col(c).cast("long") for c in columns[:k]))).alias("nbr"))


def read_points(spark: SparkSession, paths: str | Sequence[str], fmt: str, kind: str = "double") -> DataFrame:
    """points in a format: wsv, wsv-id or csv-id; ValueError for another."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    readers = {"wsv": read_wsv, "wsv-id": read_wsv_id, "csv-id": lambda s, p, kind: read_delimited_id(s, p, ",", kind)}
    if fmt not in readers:
        raise ValueError(f"no format {fmt!r}; known: {', '.join(readers)}")
    return readers[fmt](spark, paths, kind=kind)


def read_queries(spark: SparkSession, path: str | None) -> DataFrame | None:
    """queries of a file without ids; None for no path."""
    return read_wsv(spark, [path]).withColumnRenamed("id", "query_id") if path else None


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """truth of lines of ids, one line a query."""
    return read_wsv(spark, [path], "long").select(F.col("id").alias("query_id"), F.explode("features").alias("nbr"))


def listed_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths that a text file lists, one a line; blank lines don't count. The list is short, so the driver reads it."""
    return [r["value"].strip() for r in numbered_lines(spark, [path]).orderBy("line_number").collect() if r["value"].strip()]
