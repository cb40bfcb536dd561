"""Incremental ingestion with Structured Streaming.

Ids are made from content, so that a batch that is replayed after a failure
writes the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..operators.graph import shared_folder


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_urls(pages: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Each URL once within the watermark: the visited set of an endless crawl."""
    return pages.withColumn("url", U.normalize_url(F.col("url"))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def progress(events: DataFrame, group: str = "user_id", status: str = "event_type") -> DataFrame:
    """Running counts of each group and status."""
    return events.groupBy(group, status).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def windowed(events: DataFrame, size: str = "1 hour", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts and sums of event-time windows (an extension: the model has no windows)."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch through `write`, which must be idempotent."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain what is there into a table of the shared folder and return it.

    The last complete result replaces those before; in append mode batches are
    added under their number, so that a replayed one is written once.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")
