"""Change streams: debouncing, last event of each path, merges by micro-batch.

Events are (event_id, path, op, ts) with op change or delete; for files they are rows of an
event table, since a file source doesn't see deletions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.incremental import last_events, merge
from ..schemas import ddl

EVENTS = ddl("event_id long, path string, op string, ts timestamp")
GAP = "500 milliseconds"
MAX_PENDING = 1000


def debounced(events: DataFrame, gap: str = GAP, key: str = "path", ts: str = "ts") -> DataFrame:
    """(key, first_ts, last_ts, n): events of a key that follow each other within ``gap``, as one.

    The same on a stream with a watermark, where a session is given out once it has closed.
    """
    return (
        events.groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
        .select(key, "first_ts", "last_ts", "n")
    )


def event_stream(spark: SparkSession, path: str, schema: StructType = EVENTS, late: str = "10 minutes", max_files: int = MAX_PENDING) -> DataFrame:
    """Events as they land as Parquet files, at most ``max_files`` files a batch, with a watermark on ts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withWatermark("ts", late)


def merge_stream(events: DataFrame, load: Callable[[], DataFrame], rows_of: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str, key: str = "path") -> StreamingQuery:
    """Keep a table current from a stream; drains what there is and ends.

    Each batch takes the last event of a key; rows of changed and deleted keys leave the table
    and ``rows_of`` (keys to their new rows) enter.  ``save`` gets the new table and the batch's
    number and must do nothing for a number that it has saved, so a repeated batch is harmless.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = last_events(batch.persist(), key)
        gone = last.where("op = 'delete'").select(key)
        new = rows_of(last.where("op = 'change'").select(key))
        touched = last.select(key)
        save(merge(load().join(touched, key, "left_anti"), new, [key], gone), number)
        batch.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, ts: str = "ts", by: str = "op") -> DataFrame:
    """Counts by tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
