"""The row rules on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from doseframe.operators.records import with_targets, with_tasks


def record_stream(wide: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Targets and tasks of a stream of wide records, appended to Parquet. The rules hold no state, so neither does this."""
    return with_tasks(with_targets(wide)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
