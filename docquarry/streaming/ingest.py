"""Streams: pages reconciled as they arrive, and events counted in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.reconcile import diff, upsert
from docquarry.runtime import cut


def reconcile_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, order: str = "fetched_at") -> StreamingQuery:
    """Put each micro-batch of pages (source_id, path, content_hash, ...) over the stored
    ones. A batch that changes nothing writes nothing; a batch that is delivered again
    after a failure leads to the same state."""

    def batch(rows: DataFrame, number: int) -> None:
        old = read()
        new = cut(upsert(old, rows, ["source_id", "path"], [order]))
        if diff(new, old).where("action <> 'keep'").take(1):
            write(new, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per key in tumbling windows; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def deduplicated(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
