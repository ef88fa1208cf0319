"""Live ingestion: a stream of JSON lines upserted, batch by batch, into versions of a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.knowledge import ingest, latest
from tessera.sources.corpus import SCHEMA, typed_documents, valid_documents
from tessera.sources.versions import Versions


def document_stream(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(directory)


def start_ingest(spark: SparkSession, incoming: str, versions: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch writes version=<batch>; a version is complete once written and is never changed.

    A batch that is run again after a failure writes the same version from the
    same predecessor, so the result is the same.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(versions)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def apply(batch: DataFrame, number: int) -> None:
        good, _ = valid_documents(batch)
        new = latest(typed_documents(good), ["doc_id"], ["version", "effective_date", "text"])
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)] if fs.exists(root) else []
        before = max((v for v in done if v < number), default=None)
        rows = new if before is None else ingest(spark.read.schema(new.schema).parquet(f"{versions}/version={before}"), new)
        rows.write.mode("overwrite").parquet(f"{versions}/version={number}")

    return document_stream(spark, incoming).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_versioned_ingest(store: Versions, incoming: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch becomes a version of the store, which rewrites only the buckets the batch touches.

    The batch's number is the version's, so a batch that is run again finds its version complete, or writes it anew.
    """

    def apply(batch: DataFrame, number: int) -> None:
        good, _ = valid_documents(batch)
        store.upsert(latest(typed_documents(good), ["doc_id"], ["version", "effective_date", "text"]), number)

    return document_stream(store.spark, incoming).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: counts and sums of events by type in tumbling windows, late ones dropped by watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
