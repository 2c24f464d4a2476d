"""Work on what arrives: new files once each, running windows, and resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str | None = None, transform=None, fmt: str = "parquet", ts: str | None = None, late: str = "1 day") -> int:
    """Appends what came to ``source`` since the last call to ``target``; returns the rows added.

    The checkpoint remembers the files that were read, and with ``key`` the keys that were seen, so a second
    call adds nothing. With ``ts`` keys older than ``late`` are forgotten and the state stays bounded; without it
    every key is kept. A failed call is repeated as a whole.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    if key:
        stream = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else stream.dropDuplicates([key])
    if transform:
        stream = transform(stream)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, size: str = "100 seconds", step: str = "50 seconds", late: str = "10 minutes") -> DataFrame:
    """Means over sliding windows of a stream or table; a stream forgets windows older than its watermark."""
    events = events.withWatermark(ts, late) if events.isStreaming else events
    return events.groupBy(F.window(ts, size, step), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def live_bouts(epochs: DataFrame, ts: str, keys: list[str], gap: str = "31 seconds", late: str = "10 minutes", min_sec: float = 200.0, epoch_sec: float = 30.0) -> DataFrame:
    """Runs of member epochs in a stream or table as session windows that a gap ends."""
    epochs = epochs.withWatermark(ts, late) if epochs.isStreaming else epochs
    runs = epochs.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("epochs"), F.min(ts).alias("first"))
    return runs.filter(F.col("epochs") * epoch_sec >= min_sec).select(*keys, "first", "epochs")
