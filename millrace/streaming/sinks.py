"""Routed sinks of streams: rows without a problem to one folder, the others to a second, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.jsonl import write


def routed(stream: DataFrame, passed: str, failed: str, problem: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes JSON lines below passed and failed, a folder for each batch.

    A batch that runs again after a failure has the same number and the same rows, and writes over what it left, so each
    row is there once. Without a trigger, what is there now is processed and the query ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            write(batch.where(F.col(problem).isNull()).drop(problem), f"{passed}/batch={number:09d}")
            write(batch.where(F.col(problem).isNotNull()), f"{failed}/batch={number:09d}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
