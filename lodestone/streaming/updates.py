"""Upkeep of a stored text index from a stream of changed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import SegmentedIndex


def follow(changes: DataFrame, folder: str, checkpoint: str, kind: str = "unicode") -> StreamingQuery:
    """Keep the segmented index in ``folder`` up to date with a stream ``doc_id, body, version`` (a null body deletes).

    Each batch is a segment, and segments are merged as they gather; a batch that runs again changes nothing. Read the index at any time
    with ``SegmentedIndex(spark, folder, kind).read()``.
    """

    def write(batch: DataFrame, number: int) -> None:
        index = SegmentedIndex(batch.sparkSession, folder, kind)
        index.apply(batch, number)
        index.compact()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
