"""Searches of a Voronoi index whose rounds live in a stream's state: each query goes on by itself and is answered when it is done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecloom.operators.nearest import nearest_in_buckets
from vecloom.operators.voronoi import VoronoiIndex, nearest_cells
from vecloom.schema import require_k

#: What a query waits for: hop -1 and its first cells, then what the cells of a hop have, nearest first.
EVENT = "query_id long, hop int, features array<double>, cells array<int>, found array<struct<distance:double,nbr:long,cells:array<int>>>"
STATE = "features array<double>, hop int, asked array<int>, nbrs array<long>, distances array<double>"
#: A request for a hop's cells, or a result of a query that is done.
STEP = "query_id long, hop int, features array<double>, cells array<int>, rank int, nbr long, distance double"


def _advance(k: int, hops: int):
    """A query's next step from the events that came: the first one opens it, what a hop's cells have leads to the next hop or the end.

    An event of a hop that the query doesn't wait for is ignored, so one that comes again changes nothing.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        query, steps = int(key[0]), []
        events = sorted((e for frame in frames for e in frame.itertuples(index=False)), key=lambda e: e.hop)
        for e in events:
            if e.hop < 0:
                if not state.exists:
                    cells, features = [int(c) for c in e.cells], [float(x) for x in e.features]
                    state.update((features, 0, cells, [], []))
                    steps.append((query, 0, features, cells, None, None, None))
                continue
            if not state.exists or state.get[1] != e.hop:
                continue
            features, hop, asked, nbrs, distances = (list(x) if i != 1 else x for i, x in enumerate(state.get))
            bound = distances[-1] if len(distances) >= k else float("inf")
            came = [(float(f["distance"]), int(f["nbr"]), f["cells"]) for f in e.found if f["distance"] < bound]
            best = sorted({(d, n) for d, n, _ in came} | set(zip(distances, nbrs, strict=True)))[:k]
            cells = sorted({int(c) for *_, own in came for c in own} - set(asked))
            if hop == hops or not cells:
                state.remove()
                steps += [(query, None, None, None, rank, n, d) for rank, (d, n) in enumerate(best, 1)]
            else:
                state.update((features, hop + 1, asked + cells, [n for _, n in best], [d for d, _ in best]))
                steps.append((query, hop + 1, features, cells, None, None, None))
        if steps:
            yield pd.DataFrame(steps, columns=["query_id", "hop", "features", "cells", "rank", "nbr", "distance"]).astype({"hop": "Int32", "rank": "Int32", "nbr": "Int64", "distance": "Float64"})

    return run


def _answers(requests: DataFrame, index: VoronoiIndex, k: int, rank: int) -> DataFrame:
    """For each request what its cells have, each cell's k nearest with their own nearest cells; k a cell at most, so lists are short."""
    asked = requests.select("query_id", "features", F.explode("cells").alias("cell"))
    cells = index._of_cells(asked)
    near = nearest_in_buckets(asked.select("query_id", "features", F.col("cell").cast("long").alias("bucket")), cells.select(F.col("cell").cast("long").alias("bucket"), "id", "features"), k, index.metric)
    named = near.join(cells.select(F.col("id").alias("nbr"), F.slice("cells", 1, rank).alias("cells")), "nbr")
    lists = named.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "nbr", "cells"))).alias("found"))
    none = F.array().cast("array<struct<distance:double,nbr:bigint,cells:array<int>>>")
    return requests.select("query_id", "hop", "features", "cells").join(lists, "query_id", "left").withColumn("found", F.coalesce("found", none))


def start_rounds(spark: SparkSession, queries: DataFrame, index: VoronoiIndex, k: int, path: str, *, hops: int, initial: int = 1, **trigger) -> StreamingQuery:
    """Starts a stream that answers the queries (query_id, features) of a stream in rounds, as VoronoiIndex.search would.

    State has each open query's vector, hop, cells asked and best points. A batch's requests are searched in the index, and what they find
    comes back to the stream through the folder `path`/found, in the next batch or after a restart; results are in `path`/results once a
    query is done, and its state is gone. An id is one query while it is open; queries without a vector have no results. Batches that come
    again replace their results, and the state ignores what it has had.
    """
    require_k(k)
    if hops < 0 or initial < 1:
        raise ValueError(f"hops >= 0 and initial >= 1 are asked for: {hops}, {initial}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/found")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    nothing = F.lit(None).cast("array<struct<distance:double,nbr:bigint,cells:array<int>>>")
    first = nearest_cells(queries, index.seeds, initial, index.metric, "query_id").select("query_id", F.lit(-1).alias("hop"), "features", "cells", nothing.alias("found"))
    back = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(f"{path}/found")
    steps = first.unionByName(back).groupBy("query_id").applyInPandasWithState(_advance(k, hops), STEP, STATE, "append", GroupStateTimeout.NoTimeout)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("rank IS NOT NULL").select("query_id", "rank", "nbr", "distance").write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        requests = batch.where("hop IS NOT NULL").drop("rank", "nbr", "distance")
        if requests.limit(1).count():
            _answers(requests, index, k, index.rank).write.mode("overwrite").parquet(f"{path}/found/batch={number}")
        batch.unpersist()

    return steps.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()
