"""Incremental ingestion with Structured Streaming: documents that arrive become chunks once, metrics by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import chunking


#: Keeps what a stream has seen on the executors' disks, so that a batch costs what it brings.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest(spark: SparkSession, folder: str, schema: str, into: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Parquet files that appear in folder (doc_id, text) as sliding chunks under into, each chunk once. Run until what is there is done.

    The ids of chunks are keyed state, dealt by their hash: a batch looks up its own ids and writes its own chunks, however many there were before, and nothing that was written is read. The sink lists
    the files of a batch when the batch is whole, and a batch that is run again changes nothing."""
    found = chunking.sliding(spark.readStream.schema(schema).parquet(folder), size, overlap).dropDuplicates(["chunk_id"])
    name, kind = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:  # a query takes the settings of its session when it starts
        return found.writeStream.format("parquet").outputMode("append").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def windowed_metrics(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and mean values by event_type and window of ts; on a stream, events later than late are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without those delivered again within the lateness that is waited for."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
