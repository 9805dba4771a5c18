"""An index of Voronoi cells around seeds, searched cell by cell in a few hops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.hashing import draw
from vecloom.functions.metrics import Metric
from vecloom.operators.nearest import nearest_in_buckets, nearest_of_few, ranked
from vecloom.plans.loop import materialise
from vecloom.schema import require_k

if TYPE_CHECKING:
    from vecloom.operators.local_graph import LocalGraphs


def select_seeds(points: DataFrame, count: int, seed: int = 123) -> DataFrame:
    """(cell, features) of `count` points drawn by hash; cells are numbered by the points' ids."""
    chosen = points.orderBy(draw(F.col("id"), seed), "id").limit(count)
    return chosen.select((F.row_number().over(W.orderBy("id")) - 1).alias("cell"), "features")


def nearest_cells(rows: DataFrame, seeds: DataFrame, rank: int, metric_name: str | Metric = "l2", key: str = "id") -> DataFrame:
    """(key, features, cells): the `rank` nearest cells of each row, the nearest first; rows aren't shuffled unless seeds are very many."""
    near = nearest_of_few(rows, seeds.select(F.col("cell").cast("long").alias("id"), "features"), rank, metric_name, key, "cells")
    return near.withColumn("cells", F.col("cells").cast("array<int>"))


@dataclass(frozen=True)
class VoronoiIndex:
    """seeds (cell, features) and assign (id, features, cells, cell): a point lies in its nearest cell and knows the next ones."""

    seeds: DataFrame
    assign: DataFrame
    rank: int
    metric: str | Metric = "l2"
    #: If assign is stored by shelf, cell modulo so many, a search reads the shelves that it asks alone.
    shelves: int | None = None

    def _of_cells(self, cells: DataFrame) -> DataFrame:
        """assign, or of a stored one the shelves of these cells, as a filter on its folders."""
        if self.shelves is None:
            return self.assign
        asked = cells.select(F.pmod("cell", F.lit(self.shelves)).alias("shelf")).distinct().collect()
        return self.assign.where(F.col("shelf").isin(sorted(r["shelf"] for r in asked)))

    def size(self) -> int:
        return self.assign.count()

    def cell_sizes(self) -> DataFrame:
        return self.assign.groupBy("cell").agg(F.count("*").alias("points"))

    def visit(self, visitor: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What a user's function makes of the index's points (id, features, cell), which it gets in Arrow batches where they lie."""
        return self.assign.select("id", "features", "cell").mapInArrow(visitor, schema)

    def insert(self, points: DataFrame) -> VoronoiIndex:
        """The index with more points; ValueError if an id is there already or twice among them."""
        taken = points.join(self.assign.select("id"), "id", "left_semi").select("id").unionByName(points.groupBy("id").count().where("count > 1").select("id")).limit(1).collect()
        if taken:
            raise ValueError(f"id {taken[0]['id']} is there already")
        more = build_voronoi(points, self.seeds, self.rank, self.metric).assign
        return VoronoiIndex(self.seeds, self.assign.select(more.columns).unionByName(more), self.rank, self.metric)

    def search(self, queries: DataFrame, k: int, *, hops: int, initial: int = 1, rank: int | None = None, coalesce: bool = False, local: LocalGraphs | None = None, ef: int = 64) -> DataFrame:
        """results after up to 1 + hops rounds.

        Round 0 asks the `initial` nearest cells. Every point that comes within a query's k-th distance names its `rank` nearest
        cells; those that weren't asked yet are the next round's. In a cell the search is exact, or by its `local` graph, if
        given, with `ef` points in hand. With `coalesce`, queries of
        equal vectors are asked once, for all of them. Queries without a vector, or with nulls or NaN in it, have no results.
        """
        rank = self.rank if rank is None else rank
        require_k(k)
        if hops < 0 or initial < 1 or not 1 <= rank <= self.rank:
            raise ValueError(f"hops >= 0, initial >= 1 and 1 <= rank <= {self.rank} are asked for: {hops}, {initial}, {rank}")
        if coalesce:
            leads = materialise(queries.where("features IS NOT NULL").groupBy("features").agg(F.min("query_id").alias("lead")))
            found = self.search(leads.select(F.col("lead").alias("query_id"), "features"), k, hops=hops, initial=initial, rank=rank, local=local, ef=ef)
            members = queries.join(leads, "features").select(F.col("query_id").alias("member"), F.col("lead").alias("query_id"))
            return members.join(found, "query_id").select(F.col("member").alias("query_id"), "rank", "nbr", "distance")
        frontier = nearest_cells(queries, self.seeds, initial, self.metric, "query_id").select("query_id", F.explode("cells").alias("cell"))
        asked, best = None, None
        for hop in range(hops + 1):
            frontier = materialise(frontier)
            asked = frontier if asked is None else asked.unionByName(frontier)
            cells = self._of_cells(frontier)
            here = frontier.join(queries.select("query_id", "features"), "query_id").select("query_id", "features", F.col("cell").cast("long").alias("bucket"))
            near = local.nearest(here, k, ef) if local else nearest_in_buckets(here, cells.select(F.col("cell").cast("long").alias("bucket"), "id", "features"), k, self.metric)
            found = near.select("query_id", "nbr", "distance")
            if best is not None:
                bounds = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
                found = found.join(bounds, "query_id", "left").where(F.col("bound").isNull() | (F.col("distance") < F.col("bound"))).drop("bound")
            found = materialise(found)
            best = materialise(ranked(found if best is None else found.unionByName(best.drop("rank")), k))
            if hop < hops:
                pointers = cells.select(F.col("id").alias("nbr"), F.slice("cells", 1, rank).alias("cells"))
                named = found.join(pointers, "nbr").select("query_id", F.explode("cells").alias("cell")).distinct()
                frontier = materialise(named.join(asked, ["query_id", "cell"], "left_anti"))
                if not frontier.limit(1).count():
                    break
        return best


def build_voronoi(points: DataFrame, seeds: DataFrame, rank: int, metric_name: str | Metric = "l2") -> VoronoiIndex:
    """The index of these points; ValueError unless 1 <= rank <= the number of seeds."""
    if not 1 <= rank <= seeds.count():
        raise ValueError(f"rank must be from 1 to the number of seeds: {rank}")
    return VoronoiIndex(seeds, nearest_cells(points, seeds, rank, metric_name).withColumn("cell", F.col("cells")[0]), rank, metric_name)
