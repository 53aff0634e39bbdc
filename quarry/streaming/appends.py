"""Micro-batches appended to a table under its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.session import Engine


def append(stream: DataFrame, engine: Engine, table: str, checkpoint: str) -> StreamingQuery:
    """Start a query that inserts each micro-batch in one commit.

    The table's manifest names the last batch that is in it, so one that is sent again after a failure is left out. A row whose
    key is in the table breaks its constraint and ends the query.
    """

    def insert(batch: DataFrame, number: int) -> None:
        engine.session().insert_rows(table, batch, (checkpoint, number))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
