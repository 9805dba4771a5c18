"""Streams of points that an index takes in, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vecloom.sources.store import VoronoiStore


def insert_stream(spark: SparkSession, points: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that adds its points (id, features) to the Voronoi store in that folder, each id once.

    The stream's state holds the ids that came, so a later row of an id is dropped, in whatever batch it comes; the query's progress counts
    these (numDroppedDuplicateRows). Each batch is the store's part of the batch's number, plus one: part 0 is what the store was made with, whose
    ids the stream doesn't know. A batch that comes again after a failure replaces its part, so all points are there once.
    """

    def add(batch: DataFrame, number: int) -> None:
        VoronoiStore.open(spark, store).insert(batch, part=number + 1, check=False)

    once = points.where("id IS NOT NULL AND features IS NOT NULL").dropDuplicates(["id"])
    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
