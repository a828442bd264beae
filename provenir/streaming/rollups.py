"""Extension: the event and file roll-ups over streams, with watermarks and state bounded by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def events_by_window(events: DataFrame, time: str, by: list[str], window: str = "7 days", late: str = "2 days") -> DataFrame:
    """Events and kinds of change per tumbling window; rows later than the watermark are dropped, a repeated event id within it counts once."""
    marked = events.withWatermark(time, late).dropDuplicatesWithinWatermark(["function_event_id"])
    return marked.groupBy(F.window(time, window), *by).agg(F.count("*").alias("events"), F.count_if(F.lower("change_type").startswith("a")).alias("added")).select("window.start", "window.end", *by, "events", "added")


def run_once(frame: DataFrame, table: str, mode: str = "append") -> None:
    """Everything that is there now, into an in-memory table of this name."""
    frame.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
