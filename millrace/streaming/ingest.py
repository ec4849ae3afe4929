"""Streaming ingestion: at-least-once delivery made exactly-once by the ledger.

A topic is a directory of files (or any streaming DataFrame, such as Kafka's);
a consumer group is a checkpoint directory.  Each micro-batch is landed by
``foreachBatch``; a batch that is delivered again after a crash has the same
content hash and is skipped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.catalog import Catalog
from millrace.sources.ingest import IngestResult, Lander


def file_topic(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Messages of a directory that files are dropped into, in file order; the rate is bounded per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def kafka_topic(spark: SparkSession, bootstrap: str, topic: str, schema: T.StructType | str, offsets_per_batch: int = 1_000_000) -> DataFrame:
    """JSON messages of a Kafka topic from its beginning. Needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", offsets_per_batch).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def replay(catalog: Catalog, lines: list[str], topic: str, per_file: int = 1000) -> int:
    """Publish JSON lines to a file topic; blank lines are skipped. Returns the number of messages."""
    rows = [x.strip() for x in lines if x.strip()]
    for x in rows:
        json.loads(x)
    for i in range(0, len(rows), per_file):
        catalog.write_text(f"{topic}/{i:012d}-{uuid.uuid4().hex[:8]}.json", "\n".join(rows[i : i + per_file]) + "\n")
    return len(rows)


def replay_frame(df: DataFrame, bootstrap: str, topic: str) -> None:
    """Publish rows as JSON messages to Kafka."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save()


def land_stream(messages: DataFrame, catalog: Catalog, dataset: str, group: str, source_name: str = "stream", after_publish=None) -> IngestResult:
    """Drain what the topic holds, then stop. ``group`` is the checkpoint directory of this consumer.

    ``after_publish(batch_id)`` is called after a batch is landed, before it is committed (for tests of crashes).
    """
    result = IngestResult()

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            Lander(catalog, dataset, source_name).land(df, result)
        finally:
            df.unpersist()
        if after_publish:
            after_publish(batch_id)

    query = messages.writeStream.foreachBatch(batch).option("checkpointLocation", group).trigger(availableNow=True).start()
    query.awaitTermination()
    return result


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; events later than ``late`` behind the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
