"""Connected components of large graphs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut, join_counted

#: Links that a task reads at least, if there are as many, whatever the number of shuffle partitions.
EDGES_A_TASK = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node that it reaches.

    Each round replaces a node's links by links to its smallest neighbour, until every node has one link, to its
    root (Kiveris et al. 2014). Minima are found before the shuffle, rows of hubs meet them by a broadcast of at most HOT_KEYS
    hubs, and each round ends in the checkpoint folder. Links from a node to itself and
    rows with nulls are ignored; repeated links don't matter. After so many `rounds`, if given, it ends where it is: nodes
    of one root are then linked, but not all that are linked have one root.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before, done = None, 0
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("m", "u").alias("m"), "degree")
        large = cut(join_counted(both.where("v > u"), least, "u", "degree").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        own = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        edges = cut(join_counted(large, own, "u", "degree").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = edges.coalesce(max(8, now[0] // EDGES_A_TASK))
        done += 1
        if now == before or now[0] == now[1] == 0 or done == rounds:
            ends = edges if rounds is None else edges.groupBy("u").agg(F.min("v").alias("v"))
            named = ends.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return named.unionByName(named.select(F.col("root").alias("node"), "root").distinct()) if rounds is None else named
        before = now
