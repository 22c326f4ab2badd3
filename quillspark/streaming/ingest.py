"""Incremental registration of pages with Structured Streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api

PAGES = "document_id string, title string, page_number int, content string"


def ingest(spark: SparkSession, source: str, root: str, checkpoint: str, provider=None, config: api.Config | None = None, once: bool = True) -> StreamingQuery:
    """Build every new Parquet file of pages below ``source`` into the store.

    A micro-batch replaces its documents as a whole, so a batch that runs again
    after a failure gives the same store."""

    def register(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            api.build_kb(batch, root, provider, config)

    stream = spark.readStream.schema(PAGES).parquet(source)
    writer = stream.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def usage_windows(calls: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Token totals by window and document of a stream (or table) of calls with a
    ``ts`` column; rows later than ``late`` are left out of a stream."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "document_name").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"))
