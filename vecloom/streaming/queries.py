"""Streams of queries, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], on_results: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that hands each batch of queries to `answer` and its results to `on_results`, with the batch's number.

    `answer` is any batch search, such as a Voronoi index's. A batch may come again after a failure, under its old number, so
    on_results should write by it.
    """

    def each(batch: DataFrame, number: int) -> None:
        on_results(answer(batch), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
