"""Appending a stream to a table: each micro-batch is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends every available row once and then stops.

    A transaction keeps the stream's checkpoint and the micro-batch's number, so a
    micro-batch that is tried again after its commit appends nothing.
    """
    write = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.foreachBatch(lambda batch, n: table.append(batch.select(*table.schema.names), (checkpoint, n)) if not batch.isEmpty() else None).start()
