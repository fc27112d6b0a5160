"""Streams into arrays: every micro-batch appends one fragment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridlake.sources.table import ArrayTable


def append_stream(rows: DataFrame, table: ArrayTable, checkpoint: str, available_now: bool = True, base: int = 0) -> StreamingQuery:
    """Append a streaming DataFrame.  The batch number is the fragment's place in time (``base`` + number, in
    milliseconds), and a batch that was committed before is skipped, so a restart neither loses nor repeats cells."""

    def write(batch: DataFrame, number: int) -> None:
        if not any(f["timestamp"] == base + number for f in table.fragments()):
            table.insert(batch, timestamp=base + number)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
