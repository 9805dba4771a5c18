"""Packing into batches of equal padded length: optimal length buckets, token-budget batches inside each."""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import cut, shuffle_partitions, table
from vecloom.llm.token_count import count_tokens

BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 500_000
#: Equal rows that are numbered together; more of them are dealt over shards in pieces.
PIECE = 10_000


def length_histogram(counted: DataFrame, length: str = "n_tokens", rows: str = "rows") -> list[tuple[int, int, int]]:
    """(length, rows, tokens) of each length, ascending: as many as there are different lengths, at most the square root of twice the tokens."""
    cells = counted.groupBy(length).agg(F.sum(rows).alias("n")).toArrow()
    return sorted((x, n, x * n) for x, n in zip(cells.column(0).to_pylist(), cells.column(1).to_pylist(), strict=True))


def optimal_bounds(histogram: Sequence[tuple[int, int, int]], buckets: int) -> list[int]:
    """Ascending longest lengths of at most `buckets` buckets, of least total padding.

    best[j] is the least padding of the first j cells; with one bucket more it is the least of
    earlier[i] + longest[j] * (rows i..j) - (tokens i..j) over i. For growing j these are lines in longest[j], so the
    lower hull gives each layer in one pass. All numbers are integers, so it is exact.
    """
    m = len(histogram)
    if not m:
        return []
    rows, tokens = [0], [0]
    for _, n, total in histogram:
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + total)
    best: list[int | None] = [0, *[None] * m]
    choices: list[array] = []
    for _ in range(min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        at, layer, choice = 0, [None] * (m + 1), array("i", bytes(4 * (m + 1)))
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = histogram[j - 1][0]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            layer[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - tokens[j]
            choice[j] = hull[at][2]
        choices.append(choice)
        best = layer
    bounds, j = [], m
    for choice in reversed(choices):
        bounds.append(histogram[j - 1][0])
        j = choice[j]
    return bounds[::-1]


def pack(rows: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, length: str = "n_tokens", key: str = "doc_id") -> DataFrame:
    """The rows (key, length) with bucket, padded_tokens, batch and place.

    A row is padded to its bucket's longest length; a batch holds as many rows of one bucket as the token budget allows,
    or a single longer one. The rows are read once and kept, equal ones as one with their number, in the checkpoint folder. Inside
    a bucket they are numbered in shards by hash, many equal ones in pieces, and the shards' numbers begin where the
    shards before end, so no task needs a whole bucket or key. Null lengths count as 0; null keys are packed as well. Repeated rows are
    packed one by one; an empty table gives an empty one; other columns are not read.
    """
    rows = rows.select(F.col(key).alias("__key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("__length"))
    counted = cut(rows.groupBy("__key", "__length").agg(F.count("*").alias("rows")))
    histogram = length_histogram(counted, "__length")
    bounds = optimal_bounds(histogram, buckets)
    shards = max(4 * shuffle_partitions(rows.sparkSession), sum(n for _, n, _ in histogram) // SHARD_ROWS)
    bucket = sum((F.when(F.col("__length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    capacity = [max(1, token_budget // max(1, b)) for b in bounds] or [1]
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(PIECE).cast("long")))).withColumn("n", F.least(F.col("rows") - F.col("piece"), F.lit(PIECE)))
    dealt = pieces.select("__key", "__length", "piece", "n", bucket.alias("bucket"), F.pmod(F.xxhash64("__key", "__length", "piece"), F.lit(shards)).cast("int").alias("shard"))
    counts = dealt.groupBy("bucket", "shard").agg(F.sum("n").alias("in_shard"))
    begins = counts.select("bucket", "shard", (F.sum("in_shard").over(W.partitionBy("bucket").orderBy("shard")) - F.col("in_shard")).alias("begin"))
    before = F.sum("n").over(W.partitionBy("bucket", "shard").orderBy("__key", "__length", "piece").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    placed = dealt.withColumn("before", before).join(begins, ["bucket", "shard"]).withColumn("first", F.col("before") + F.col("begin"))
    numbered = placed.select("__key", "__length", "bucket", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("number"))
    at = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)
    return numbered.select(
        F.col("__key").alias(key), F.col("__length").alias(length), "bucket", at(bounds or [0]).alias("padded_tokens"), F.floor(F.col("number") / at(capacity)).cast("long").alias("batch"), (F.col("number") % at(capacity)).cast("int").alias("place")
    )


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every document, by the ranks of byte_bpe_multi_50k.tiktoken; 0 for null and empty texts."""
    return count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "n_tokens")


def op5_packing(spark, sf_dir):
    """Every document by its number of tokens; see pack for nulls, repeats and empty tables. Texts of any length are counted whole."""
    return pack(token_lengths(table(spark, sf_dir, "documents")))
